"""The KPI views: thin bindings of the generic operators to the catalogue tables.

Every KPI is ``build(cat, as_of=None, seed=42)``; ``as_of`` fills ``calculated_at``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions.numeric import none
from catalens.functions.sampling import DEFAULT_SEED, seeded_top_k
from catalens.operators.confidence import ConfidenceRules, confidence, scored
from catalens.operators.coverage import code_status, coverage, coverage_gaps
from catalens.operators.duplicates import RISK, RiskRules, duplicate_candidates, duplicate_listing
from catalens.operators.evidence import Evidence, observe
from catalens.operators.identifiers import (
    presence_labels,
    presence_profile,
    presence_score,
)
from catalens.operators.links import inconsistency_shares, link_audit, link_state, unlinked_count
from catalens.operators.lookup import attach, attach_optional, repeat_names, with_linked_names
from catalens.operators.overview import overview
from catalens.plans.flags import (
    artist_flags,
    persons,
    placed_tracks,
    recording_flags,
    release_flags,
    settled,
    work_flags,
)
from catalens.sources.catalogue import Catalogue
from catalens.sources.store import shared_table

AsOf = dt.datetime | None

# Notes that readers of the views filter on.
SCOPE_COVERAGE = "Phase 1: Focus Artistes"
SCOPE_CONFIDENCE = "Phase 1+2: Logique explicite IDs + cohérence des liens"
SCOPE_MARKER = "SAMPLE_DATA"

# Identifier -> title used in the status labels.
IDENTIFIERS = {
    "ipi": "IPI",
    "isni": "ISNI",
    "viaf": "VIAF",
    "wikidata": "Wikidata",
    "imdb": "IMDB",
}
URL_IDENTIFIERS = ("viaf", "wikidata", "imdb")

# Weights, combinations and output names of the confidence scores.
CONFIDENCE = {
    "artist": ConfidenceRules(
        entities="artists",
        flags={
            "has_artist_id": "artist_id_coverage_pct",
            "has_isrc": "isrc_coverage_pct",
            "has_iswc": "iswc_coverage_pct",
            "on_release": "release_coverage_pct",
        },
        weights={"has_artist_id": "0.3", "has_iswc": "0.3", "has_isrc": "0.2", "on_release": "0.2"},
        medium=[["has_artist_id", "has_isrc"], ["has_iswc", "on_release"]],
    ),
    "work": ConfidenceRules(
        entities="works",
        flags={
            "has_iswc": "iswc_coverage_pct",
            "has_isrc": "isrc_coverage_pct",
            "has_artist_id": "artist_id_coverage_pct",
            "on_release": "release_coverage_pct",
        },
        weights={"has_iswc": "0.4", "has_artist_id": "0.3", "has_isrc": "0.2", "on_release": "0.1"},
        medium=[["has_iswc", "has_isrc"], ["has_isrc", "on_release"]],
    ),
    "recording": ConfidenceRules(
        entities="recordings",
        flags={
            "has_isrc": "isrc_coverage_pct",
            "has_iswc": "iswc_coverage_pct",
            "has_artist_id": "artist_id_coverage_pct",
            "on_release": "release_coverage_pct",
        },
        weights={"has_isrc": "0.3", "has_iswc": "0.3", "has_artist_id": "0.3", "on_release": "0.1"},
        medium=[["has_isrc", "has_iswc"], ["has_isrc", "on_release"]],
    ),
    "release": ConfidenceRules(
        entities="releases",
        flags={
            "has_date": "date_coverage_pct",
            "has_country": "country_coverage_pct",
            "has_isrc": "isrc_coverage_pct",
            "has_iswc": "iswc_coverage_pct",
            "has_artist_id": "artist_id_coverage_pct",
        },
        weights={"has_date": "0.3", "has_isrc": "0.3", "has_iswc": "0.2", "has_artist_id": "0.2"},
        medium=[["has_date", "has_isrc"], ["has_country", "has_isrc"]],
    ),
}

ENTITY_FLAGS = {
    "artist": artist_flags,
    "work": work_flags,
    "recording": recording_flags,
    "release": release_flags,
}


def _calculated_at(as_of: AsOf) -> Column:
    moment = F.current_timestamp() if as_of is None else F.lit(as_of)
    return moment.alias("calculated_at")


def _stamp(as_of: AsOf, note: str) -> list[Column]:
    return [_calculated_at(as_of), F.lit(note).alias("scope_note")]


def with_scope_note(view: DataFrame, note: str) -> DataFrame:
    """A KPI with another scope note; marker rows keep theirs."""
    if "scope_note" not in view.columns:
        return view
    own = F.when(F.col("scope_note") == SCOPE_MARKER, SCOPE_MARKER).otherwise(note)
    return view.withColumn("scope_note", own)


# --- overview ---------------------------------------------------------------------


def stats_overview(cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED) -> DataFrame:
    return overview(
        {
            "Artists": (cat["artist"], F.col("type") == 1),
            "Works": (cat["work"], None),
            "Recordings": (cat["recording"], None),
            "Releases": (cat["release"], None),
        },
        "gid",
    )


# --- code coverage ----------------------------------------------------------------


def kpi_isrc_coverage(cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED) -> DataFrame:
    figures = coverage(settled(cat["recording"]), cat["isrc"], "recording", "isrc", "recordings", shared_table)
    return figures.select("*", *_stamp(as_of, SCOPE_COVERAGE))


def kpi_iswc_coverage(cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED) -> DataFrame:
    figures = coverage(settled(cat["work"]), cat["iswc"], "work", "iswc", "works", shared_table)
    return figures.select("*", *_stamp(as_of, SCOPE_COVERAGE))


def credited_persons(cat: Catalogue) -> DataFrame:
    """(artist_credit, artist): the persons each existing credit names."""
    people = persons(cat["artist"]).select(F.col("id").alias("artist"))
    credits = cat["artist_credit"].select(F.col("id").alias("artist_credit"))
    return (
        cat["artist_credit_name"]
        .select("artist_credit", "artist")
        .join(people, "artist", "left_semi")
        .join(credits, "artist_credit", "left_semi")
    )


ISRC_GAPS = ("Recordings without ISRC", "Duplicate ISRCs")
ISWC_GAPS = ("Works without ISWC", "Duplicate ISWCs")


def kpi_isrc_coverage_samples(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    n: int = 20,
    kinds: Sequence[str] = ISRC_GAPS,
) -> DataFrame:
    """``n`` rows of all gaps of the given kinds."""
    gaps = coverage_gaps(
        settled(cat["recording"]),
        cat["isrc"],
        "recording",
        "isrc",
        ISRC_GAPS,
        carry=["artist_credit"],
    ).filter(F.col("sample_type").isin(list(kinds)))
    rows = gaps.join(credited_persons(cat), "artist_credit").select(
        "sample_type", F.col("id").alias("recording_id"), "isrc", "artist"
    )
    keys = ["sample_type", "recording_id", "artist", "isrc"]
    sample = seeded_top_k(rows, [], keys, n, seed)
    recordings = cat["recording"].select(
        F.col("id").alias("recording_id"),
        F.col("name").alias("recording_name"),
        F.col("gid").alias("recording_gid"),
    )
    artists = cat["artist"].select(
        F.col("id").alias("artist"),
        F.col("name").alias("artist_name"),
        F.col("gid").alias("artist_gid"),
    )
    described = attach(attach(sample, n, recordings, "recording_id"), n, artists, "artist")
    return seeded_top_k(described, [], keys, n, seed).select(
        "sample_type",
        "recording_id",
        "recording_name",
        "recording_gid",
        "artist_name",
        "artist_gid",
    )


def _work_columns(cat: Catalogue) -> DataFrame:
    return cat["work"].select(
        F.col("id").alias("work_id"),
        F.col("name").alias("work_name"),
        F.col("gid").alias("work_gid"),
        F.col("type").alias("work_type"),
        none("int").alias("language_code"),
        "comment",
    )


def kpi_iswc_coverage_samples(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    n: int = 20,
    kinds: Sequence[str] = ISWC_GAPS,
) -> DataFrame:
    """``n`` rows of all gaps of the given kinds."""
    gaps = coverage_gaps(settled(cat["work"]), cat["iswc"], "work", "iswc", ISWC_GAPS)
    rows = gaps.filter(F.col("sample_type").isin(list(kinds))).withColumnRenamed("id", "work_id")
    keys = ["sample_type", "work_id", "iswc"]
    sample = seeded_top_k(rows, [], keys, n, seed)
    described = attach(sample, n, _work_columns(cat), "work_id")
    return seeded_top_k(described, [], keys, n, seed).select(
        "sample_type", "work_id", "work_name", "work_gid", "work_type", "language_code"
    )


def kpi_iswc_detailed(cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED) -> DataFrame:
    rows = code_status(
        settled(cat["work"]),
        cat["iswc"],
        "work",
        "iswc",
        ("Missing ISWC", "Duplicate ISWC", "Unique ISWC"),
    )
    # The id breaks ties, so one common timestamp does not put all rows in one sort range.
    return rows.select(
        F.col("id").alias("work_id"),
        F.col("name").alias("work_name"),
        F.col("gid").alias("work_gid"),
        "iswc",
        F.col("type").alias("work_type"),
        none("int").alias("language_code"),
        "comment",
        "iswc_status",
        "edits_pending",
        "last_updated",
    ).orderBy(F.desc("last_updated"), "work_id", "iswc")


# --- artist identifiers -----------------------------------------------------------


def artist_presence(cat: Catalogue) -> DataFrame:
    """Settled persons with a 0/1 flag per identifier and their link counts."""
    links = cat["l_artist_url"]
    urls = cat["url"].select(
        F.col("id").alias("entity1"),
        *[F.contains(F.col("url"), F.lit(name)).alias(name) for name in URL_IDENTIFIERS],
    )
    known = urls.filter(" or ".join(URL_IDENTIFIERS))
    return observe(
        settled(persons(cat["artist"])),
        [
            Evidence(cat["artist_ipi"], "artist", {"ipi": None}, counts={"ipis": "1"}),
            Evidence(cat["artist_isni"], "artist", {"isni": None}, counts={"isnis": "1"}),
            Evidence(links, "entity0", counts={"urls": "1"}),
            Evidence(
                links.join(known, "entity1"),
                "entity0",
                {name: name for name in URL_IDENTIFIERS},
            ),
        ],
    )


# Each URL identifier joins the URL links once more.
ARTIST_FANOUT = {"ipis": 1, "isnis": 1, "urls": len(URL_IDENTIFIERS)}


def party_missing_ids_artist(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    figures = presence_profile(
        artist_presence(cat), list(IDENTIFIERS), "artists", fanout=ARTIST_FANOUT
    )
    return figures.select("*", *_stamp(as_of, SCOPE_COVERAGE))


def party_missing_ids_artist_distinct(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    figures = presence_profile(artist_presence(cat), list(IDENTIFIERS), "artists")
    return figures.select("*", *_stamp(as_of, SCOPE_COVERAGE))


def artists_with_gaps(cat: Catalogue) -> DataFrame:
    """Settled persons lacking at least one identifier, with their flags and score."""
    score = presence_score(list(IDENTIFIERS))
    return (
        artist_presence(cat)
        .select("id", *IDENTIFIERS, score.alias("id_completeness_score"))
        .filter(F.col("id_completeness_score") < len(IDENTIFIERS))
    )


def party_missing_ids_artist_samples(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED, n: int = 50
) -> DataFrame:
    order = [F.col("id_completeness_score")]
    sample = seeded_top_k(artists_with_gaps(cat), order, ["id"], n, seed)
    described = attach(sample, n, cat["artist"], "id")
    return seeded_top_k(described, order, ["id"], n, seed).select(
        F.col("id").alias("artist_id"),
        F.col("name").alias("artist_name"),
        F.col("gid").alias("artist_gid"),
        "sort_name",
        "begin_date_year",
        "end_date_year",
        "area",
        *presence_labels(IDENTIFIERS),
        "id_completeness_score",
    )


# --- duplicate codes --------------------------------------------------------------


def _credited_recordings(cat: Catalogue) -> DataFrame:
    return settled(cat["recording"]).withColumnRenamed("artist_credit", "credit")


def dup_isrc_unordered(cat: Catalogue, rules: RiskRules = RISK) -> DataFrame:
    return duplicate_candidates(
        _credited_recordings(cat),
        cat["isrc"],
        cat["artist_credit"],
        "recording",
        "isrc",
        rules,
    ).withColumnsRenamed(
        {
            "sample_ids": "sample_recording_ids",
            "sample_names": "sample_recording_names",
            "sample_credits": "sample_artist_credits",
        }
    )


def dup_isrc_candidates(cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED) -> DataFrame:
    # Scores are few; the code itself breaks ties so that the sort splits evenly.
    return (
        dup_isrc_unordered(cat)
        .select("*", *_stamp(as_of, SCOPE_COVERAGE))
        .orderBy(F.desc("duplicate_risk_score"), F.desc("duplicate_count"), "isrc")
    )


def dup_isrc_candidates_samples(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED, n: int = 100
) -> DataFrame:
    return duplicate_listing(
        _credited_recordings(cat), cat["isrc"], cat["artist_credit"], "recording", "isrc", n
    ).select(
        "isrc",
        F.col("id").alias("recording_id"),
        F.col("name").alias("recording_name"),
        F.col("gid").alias("recording_gid"),
        F.col("credit_name").alias("artist_credit"),
        "length",
        "comment",
        "last_updated",
        "group_size",
        "group_rank",
    )


# --- links between releases, recordings and works ---------------------------------


def recordings_on_releases(cat: Catalogue) -> DataFrame:
    """Settled recordings on settled releases, with their work links and track rows."""
    return link_state(
        settled(cat["recording"]),
        cat["l_recording_work"],
        "entity0",
        "entity1",
        path=placed_tracks(cat, settled(cat["release"])),
        path_key="recording",
    )


def works_linked(cat: Catalogue) -> DataFrame:
    return link_state(settled(cat["work"]), cat["l_recording_work"], "entity1", "entity0")


def rec_on_release_without_work(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    figures = link_audit(recordings_on_releases(cat), "recordings_on_releases", "recordings")
    columns = [
        F.col("total_recordings_on_releases"),
        F.col("recordings_with").alias("recordings_with_works"),
        F.col("recordings_without").alias("recordings_without_works"),
        F.col("with_pct").alias("recordings_with_works_pct"),
        F.col("without_pct").alias("recordings_without_works_pct"),
        *_stamp(as_of, SCOPE_COVERAGE),
    ]
    row = figures.select(*columns)
    marker = [
        (F.lit(SCOPE_MARKER) if f.name == "scope_note" else none(f.dataType.simpleString())).alias(
            f.name
        )
        for f in row.schema.fields
    ]
    both = F.array(F.struct(*[F.col(c) for c in row.columns]), F.struct(*marker))
    return row.select(F.inline(both))


def rec_on_release_without_work_samples(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED, n: int = 50
) -> DataFrame:
    placed = (
        placed_tracks(cat, settled(cat["release"]))
        .groupBy("recording", "release")
        .agg(F.count(F.lit(1)).alias("tracks"))
        .withColumnsRenamed({"recording": "recording_id", "release": "release_id"})
    )
    state = link_state(
        settled(cat["recording"]), cat["l_recording_work"], "entity0", "entity1"
    ).select(F.col("id").alias("recording_id"), "linked", "links")
    rows = placed.join(state, "recording_id").withColumn(
        "work_count", F.col("links") * F.col("tracks")
    )
    keys, order = ["recording_id", "release_id"], [F.col("work_count")]
    sample = seeded_top_k(rows, order, keys, n, seed)

    recordings = cat["recording"].select(
        F.col("id").alias("recording_id"),
        F.col("name").alias("recording_name"),
        F.col("gid").alias("recording_gid"),
        F.col("artist_credit").alias("credit"),
        "length",
        "comment",
    )
    releases = cat["release"].select(
        F.col("id").alias("release_id"),
        F.col("name").alias("release_name"),
        F.col("gid").alias("release_gid"),
        "release_group",
    )
    credits = cat["artist_credit"].select(
        F.col("id").alias("credit"), F.col("name").alias("artist_credit")
    )
    groups = cat["release_group"].select(
        F.col("id").alias("release_group"),
        F.col("name").alias("release_group_name"),
        F.col("type").alias("release_group_type"),
    )
    sample = with_linked_names(
        sample,
        cat["l_recording_work"].withColumnRenamed("entity0", "recording_id"),
        "recording_id",
        "entity1",
        cat["work"].select(F.col("id").alias("entity1"), "name"),
    )
    base = attach(attach(sample, n, recordings, "recording_id"), n, releases, "release_id")
    described = attach_optional(base, credits, "credit")
    described = attach_optional(described, groups, "release_group")
    return seeded_top_k(described, order, keys, n, seed).select(
        "recording_id",
        "recording_name",
        "recording_gid",
        "artist_credit",
        "length",
        "comment",
        "release_id",
        "release_name",
        "release_gid",
        "release_group_name",
        "release_group_type",
        F.when(F.col("linked") == 1, "Has Work Link")
        .otherwise("No Work Link")
        .alias("work_status"),
        "work_count",
        repeat_names("names", ["tracks"]).alias("associated_works"),
    )


def _work_audit(cat: Catalogue, as_of: AsOf, distinct_entities: bool) -> DataFrame:
    figures = link_audit(works_linked(cat), "works", "works", distinct_entities)
    return figures.select(
        "total_works",
        F.col("works_with").alias("works_with_recordings"),
        F.col("works_without").alias("works_without_recordings"),
        F.col("with_pct").alias("works_with_recordings_pct"),
        F.col("without_pct").alias("works_without_recordings_pct"),
        *_stamp(as_of, SCOPE_COVERAGE),
    )


def work_without_recording(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    return _work_audit(cat, as_of, distinct_entities=False)


def work_without_recording_distinct(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    return _work_audit(cat, as_of, distinct_entities=True)


def work_without_recording_samples(
    cat: Catalogue, as_of: AsOf = None, seed: int = DEFAULT_SEED, n: int = 50
) -> DataFrame:
    codes = (
        cat["iswc"].groupBy(F.col("work").alias("work_id"), "iswc").agg(
            F.count(F.lit(1)).alias("code_rows")
        )
    )
    rows = (
        works_linked(cat)
        .select(F.col("id").alias("work_id"), "linked", "links")
        .join(codes, "work_id", "left")
        .withColumn("code_rows", F.coalesce("code_rows", F.lit(1)))
        .withColumn("recording_count", F.col("links") * F.col("code_rows"))
    )
    keys, order = ["work_id", "iswc"], [F.col("recording_count")]
    sample = seeded_top_k(rows, order, keys, n, seed)
    sample = with_linked_names(
        sample,
        cat["l_recording_work"].withColumnRenamed("entity1", "work_id"),
        "work_id",
        "entity0",
        cat["recording"].select(F.col("id").alias("entity0"), "name"),
    )
    described = attach(sample, n, _work_columns(cat), "work_id")
    return seeded_top_k(described, order, keys, n, seed).select(
        "work_id",
        "work_name",
        "work_gid",
        "work_type",
        "language_code",
        "comment",
        "iswc",
        F.when(F.col("linked") == 1, "Has Recording Link")
        .otherwise("No Recording Link")
        .alias("recording_status"),
        "recording_count",
        repeat_names("names", ["code_rows"]).alias("associated_recordings"),
    )


def work_recording_inconsistencies(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    distinct_entities: bool = False,
) -> DataFrame:
    weight = "1" if distinct_entities else "paths"
    return (
        inconsistency_shares(
            {
                "Recordings without Works": unlinked_count(recordings_on_releases(cat), weight),
                "Works without Recordings": unlinked_count(works_linked(cat)),
            }
        )
        .select("*", _calculated_at(as_of))
        .orderBy(F.desc("count"), "inconsistency_type")
    )


# --- confidence -------------------------------------------------------------------


def confidence_summary(
    entity: str, cat: Catalogue, as_of: AsOf = None, recordings: DataFrame | None = None
) -> DataFrame:
    """Summary row of one entity kind; ``recordings`` shares ready recording_facts."""
    figures = confidence(ENTITY_FLAGS[entity](cat, recordings), CONFIDENCE[entity])
    return figures.select("*", *_stamp(as_of, SCOPE_CONFIDENCE))


def confidence_scored(
    entity: str, cat: Catalogue, recordings: DataFrame | None = None
) -> DataFrame:
    """Every entity of the population with its flags, levels and score."""
    return scored(ENTITY_FLAGS[entity](cat, recordings), CONFIDENCE[entity])


def _confidence_sample(
    entity: str,
    cat: Catalogue,
    seed: int,
    n: int,
    described_by: list[Column],
    code: str | None = None,
    recordings: DataFrame | None = None,
) -> DataFrame:
    order = [F.desc("phase2_confidence_score")]
    sample = seeded_top_k(confidence_scored(entity, cat, recordings), order, ["id"], n, seed)
    if code is not None:
        # Of several codes the smallest, so that the choice is repeatable.
        held = cat[code].select(F.col(entity).alias("id"), code)
        sample = sample.join(held, "id", "left").groupBy(*sample.columns).agg(F.min(code).alias(code))
    described = attach(sample, n, cat[entity], "id")
    top = seeded_top_k(described, order, ["id"], n, seed)
    return top.select(
        F.col("id").alias(f"{entity}_id"),
        F.col("name").alias(f"{entity}_name"),
        F.col("gid").alias(f"{entity}_gid"),
        *described_by,
        *CONFIDENCE[entity].flags,
        "phase1_confidence_level",
        "phase2_confidence_score",
        "phase2_confidence_level",
        F.col("phase2_confidence_level").alias("confidence_level"),
        F.col("phase2_confidence_score").alias("confidence_score"),
    )


def confidence_artist(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    recordings: DataFrame | None = None,
) -> DataFrame:
    return confidence_summary("artist", cat, as_of, recordings)


def confidence_artist_samples(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    n: int = 50,
    recordings: DataFrame | None = None,
) -> DataFrame:
    columns = [
        F.col("sort_name"),
        none("smallint").alias("begin_date"),
        none("smallint").alias("end_date"),
        F.col("area"),
    ]
    return _confidence_sample("artist", cat, seed, n, columns, recordings=recordings)


def confidence_work(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    recordings: DataFrame | None = None,
) -> DataFrame:
    return confidence_summary("work", cat, as_of, recordings)


def confidence_work_samples(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    n: int = 50,
    recordings: DataFrame | None = None,
) -> DataFrame:
    columns = [
        F.col("type").alias("work_type"),
        none("int").alias("language_code"),
        F.col("iswc"),
    ]
    return _confidence_sample("work", cat, seed, n, columns, "iswc", recordings)


def confidence_recording(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    recordings: DataFrame | None = None,
) -> DataFrame:
    return confidence_summary("recording", cat, as_of, recordings)


def confidence_recording_samples(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    n: int = 50,
    recordings: DataFrame | None = None,
) -> DataFrame:
    columns = [F.col("length"), F.col("isrc")]
    return _confidence_sample("recording", cat, seed, n, columns, "isrc", recordings)


def confidence_release(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    recordings: DataFrame | None = None,
) -> DataFrame:
    return confidence_summary("release", cat, as_of, recordings)


def confidence_release_samples(
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    n: int = 50,
    recordings: DataFrame | None = None,
) -> DataFrame:
    columns = [
        none("smallint").alias("date_year"),
        none("smallint").alias("date_month"),
        none("smallint").alias("date_day"),
        none("int").alias("country"),
    ]
    return _confidence_sample("release", cat, seed, n, columns, recordings=recordings)


# --- registry ---------------------------------------------------------------------


@dataclass(frozen=True)
class Kpi:
    build: Callable[..., DataFrame]
    description: str

    @property
    def name(self) -> str:
        return self.build.__name__


KPIS: dict[str, Kpi] = {
    kpi.name: kpi
    for kpi in (
        Kpi(stats_overview, "Row totals and opaque-id presence per entity type"),
        Kpi(kpi_isrc_coverage, "Recordings with an ISRC, and ISRCs several recordings share"),
        Kpi(kpi_isrc_coverage_samples, "Sampled recordings without an ISRC or with a shared one"),
        Kpi(kpi_iswc_coverage, "Works with an ISWC, and ISWCs several works share"),
        Kpi(kpi_iswc_coverage_samples, "Sampled works without an ISWC or with a shared one"),
        Kpi(kpi_iswc_detailed, "Every work and ISWC with its status"),
        Kpi(party_missing_ids_artist, "External identifiers of persons, per join row"),
        Kpi(party_missing_ids_artist_distinct, "External identifiers of persons, per person"),
        Kpi(party_missing_ids_artist_samples, "Persons lacking identifiers, worst first"),
        Kpi(dup_isrc_candidates, "Shared ISRCs with similarity, risk score and risk level"),
        Kpi(dup_isrc_candidates_samples, "Recordings behind the first shared ISRCs"),
        Kpi(rec_on_release_without_work, "Released recordings with and without a work"),
        Kpi(rec_on_release_without_work_samples, "Released recordings, fewest works first"),
        Kpi(work_without_recording, "Works with and without a recording, per join row"),
        Kpi(work_without_recording_distinct, "Works with and without a recording, per work"),
        Kpi(work_without_recording_samples, "Works, fewest recordings first"),
        Kpi(work_recording_inconsistencies, "Both kinds of missing link side by side"),
        Kpi(confidence_artist, "Confidence levels of persons"),
        Kpi(confidence_artist_samples, "Persons with the highest confidence scores"),
        Kpi(confidence_work, "Confidence levels of works"),
        Kpi(confidence_work_samples, "Works with the highest confidence scores"),
        Kpi(confidence_recording, "Confidence levels of recordings"),
        Kpi(confidence_recording_samples, "Recordings with the highest confidence scores"),
        Kpi(confidence_release, "Confidence levels of releases"),
        Kpi(confidence_release_samples, "Releases with the highest confidence scores"),
    )
}


def register(
    spark: SparkSession,
    cat: Catalogue,
    as_of: AsOf = None,
    seed: int = DEFAULT_SEED,
    recordings: DataFrame | None = None,
    scope_note: str | None = None,
) -> list[str]:
    """Publish every KPI as a temporary view of its name; running it again replaces them.

    ``recordings`` are ready recording facts for the confidence views to share;
    ``scope_note`` stands in for the default notes.
    """
    for kpi in KPIS.values():
        shared = {"recordings": recordings} if kpi.name.startswith("confidence_") else {}
        view = kpi.build(cat, as_of=as_of, seed=seed, **shared)
        if scope_note is not None:
            view = with_scope_note(view, scope_note)
        view.createOrReplaceTempView(kpi.name)
    return list(KPIS)
