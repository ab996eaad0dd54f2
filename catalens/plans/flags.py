"""The presence flags that confidence scoring rests on, for each kind of entity.

Flags are worked out once per recording and then rolled up over the links: "some
recording of X has Y" is the OR of Y over X's recordings.  Recordings, works and credits
reached through a link count whether or not their own edits are settled; only the scored
entity itself is filtered.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.operators.evidence import Evidence, observe
from catalens.operators.skew import salted_join
from catalens.sources.catalogue import Catalogue
from catalens.sources.store import shared_table

RECORDING_FLAGS = ("has_isrc", "has_iswc", "has_artist_id", "on_release")
#: What works and releases take over from their recordings.
WORK_ROLL_UP = ("has_isrc", "has_artist_id", "on_release")
RELEASE_ROLL_UP = ("has_isrc", "has_iswc", "has_artist_id")


def settled(df: DataFrame) -> DataFrame:
    return df.where("edits_pending = 0")


def persons(artist: DataFrame) -> DataFrame:
    return artist.where("type = 1")


def coded_rows(cat: Catalogue, table: str) -> DataFrame:
    """Rows of isrc or iswc that do hold a code."""
    return cat[table].where(f"{table} is not null")


def placed_tracks(cat: Catalogue, releases: DataFrame) -> DataFrame:
    """(recording, release) of every track on a medium of one of ``releases``."""
    media = cat["medium"].join(
        releases.select(F.col("id").alias("release")), "release", "left_semi"
    )
    return (
        cat["track"]
        .select("recording", "medium")
        .join(media.select(F.col("id").alias("medium"), "release"), "medium")
        .select("recording", "release")
    )


def _identified_credits(cat: Catalogue) -> DataFrame:
    """Credits that name at least one artist with an ISNI or IPI."""
    artists = cat["artist_isni"].select("artist").union(cat["artist_ipi"].select("artist"))
    named = salted_join(
        cat["artist_credit_name"], artists.distinct(), "artist", "left_semi", ["artist_credit"]
    )
    credits = observe(
        cat["artist_credit"],
        [Evidence(named, "artist_credit", {"identified": None})],
        key="artist_credit",
    )
    return credits.where("identified = 1").select("artist_credit")


def recording_facts(cat: Catalogue, needed: Iterable[str] = RECORDING_FLAGS) -> DataFrame:
    """Per recording: id, artist_credit, settled and the ``needed`` flags as 0/1."""
    needed = set(needed)
    own = {"settled": "edits_pending = 0"}
    rows = cat["recording"].select("id", "artist_credit", "edits_pending")
    if "has_artist_id" in needed:
        identified = _identified_credits(cat).selectExpr("artist_credit", "true as identified")
        rows = salted_join(rows, identified, "artist_credit", "left", ["id"])
        own["has_artist_id"] = "identified"
    evidence = []
    if "has_isrc" in needed:
        evidence.append(Evidence(coded_rows(cat, "isrc"), "recording", {"has_isrc": None}))
    if "has_iswc" in needed:
        coded = [Evidence(coded_rows(cat, "iswc"), "work", {"coded": None})]
        works = observe(cat["work"], coded, key="entity1").where("coded = 1")
        linked = salted_join(
            cat["l_recording_work"], works.select("entity1"), "entity1", "left_semi", ["entity0"]
        )
        evidence.append(Evidence(linked, "entity0", {"has_iswc": None}))
    if "on_release" in needed:
        placed = placed_tracks(cat, cat["release"])
        evidence.append(Evidence(placed, "recording", {"on_release": None}))
    return observe(rows, evidence, flags=own, carry=["artist_credit"])


def shared_facts(cat: Catalogue) -> DataFrame:
    """The recording facts written once, for several roll-ups to read."""
    return shared_table(recording_facts(cat), "recording_facts")


def artist_flags(cat: Catalogue, recordings: DataFrame | None = None) -> DataFrame:
    """Settled persons: has_artist_id, has_isrc, has_iswc, on_release."""
    names = ("has_isrc", "has_iswc", "on_release")
    facts = recording_facts(cat, names) if recordings is None else recordings
    # Folded per credit first: a catch-all credit is one row before it meets its artists.
    credits = observe(
        cat["artist_credit"],
        [Evidence.of_flags(facts, "artist_credit", names)],
        key="artist_credit",
    )
    credited = cat["artist_credit_name"].select("artist_credit", "artist")
    credited = salted_join(credited, credits, "artist_credit", "inner", ["artist"])
    return observe(
        settled(persons(cat["artist"])),
        [
            Evidence(cat["artist_isni"], "artist", {"has_artist_id": None}),
            Evidence(cat["artist_ipi"], "artist", {"has_artist_id": None}),
            Evidence.of_flags(credited, "artist", names),
        ],
    )


def work_flags(
    cat: Catalogue, recordings: DataFrame | None = None, linked: DataFrame | None = None
) -> DataFrame:
    """Settled works: has_iswc, has_isrc, has_artist_id, on_release.

    ``linked`` shares ready work links with the flags of their recordings.
    """
    names = WORK_ROLL_UP
    if linked is None:
        facts = recording_facts(cat, names) if recordings is None else recordings
        linked = cat["l_recording_work"].join(
            facts.select(F.col("id").alias("entity0"), *names), "entity0"
        )
    return observe(
        settled(cat["work"]),
        [
            Evidence(coded_rows(cat, "iswc"), "work", {"has_iswc": None}),
            Evidence.of_flags(linked, "entity1", names),
        ],
    )


def recording_flags(cat: Catalogue, recordings: DataFrame | None = None) -> DataFrame:
    """Settled recordings: has_isrc, has_iswc, has_artist_id, on_release."""
    facts = recording_facts(cat) if recordings is None else recordings
    return facts.where("settled = 1").select("id", *RECORDING_FLAGS)


def release_flags(
    cat: Catalogue,
    recordings: DataFrame | None = None,
    has_date: str = "release_group_type is not null",
    has_country: str = "status is not null",
    tracks: DataFrame | None = None,
) -> DataFrame:
    """Settled releases: has_date, has_country, has_isrc, has_iswc, has_artist_id.

    The catalogue holds no dates or countries, so by default a typed release group
    stands in for a date and a status for a country.  A caller whose release table has
    the real columns passes SQL conditions over them.  ``tracks`` shares ready tracks (by
    medium) with the flags of their recordings.
    """
    names = RELEASE_ROLL_UP
    groups = cat["release_group"].select(
        F.col("id").alias("release_group"), F.col("type").alias("release_group_type")
    )
    if tracks is None:
        facts = recording_facts(cat, names) if recordings is None else recordings
        placed = (
            cat["track"]
            .select("id", "recording", "medium")
            .join(cat["medium"].select(F.col("id").alias("medium"), "release"), "medium")
            .select("id", "recording", "release")
        )
        by_recording = facts.select(F.col("id").alias("recording"), *names)
        on_releases = salted_join(placed, by_recording, "recording", "inner", ["id"], keys_from=cat["track"])
    else:
        # Folded per medium first: a medium's tracks are one row before they meet its release.
        on_releases = observe(
            cat["medium"].select("id", "release"),
            [Evidence.of_flags(tracks, "medium", names)],
            carry=["release"],
            key="medium",
        )
    return observe(
        settled(cat["release"]).join(groups, "release_group", "left"),
        [Evidence.of_flags(on_releases, "release", names)],
        flags={"has_date": has_date, "has_country": has_country},
    )
