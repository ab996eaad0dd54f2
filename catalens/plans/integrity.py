"""The catalogue's keys, checked by value."""

from __future__ import annotations

from pyspark.sql import DataFrame

from catalens.operators.integrity import Reference, key_report, key_words, violations
from catalens.sources.catalogue import Catalogue
from catalens.sources.store import shared_table

# The primary keys of the catalogue and the columns that refer to them.
KEYS = ("artist", "url", "artist_credit", "recording", "work", "release_group", "release", "medium", "track")
REFERENCES = (
    *(Reference(table, "id", table) for table in KEYS),
    Reference("artist_ipi", "artist", "artist"),
    Reference("artist_isni", "artist", "artist"),
    Reference("l_artist_url", "entity0", "artist"),
    Reference("l_artist_url", "entity1", "url"),
    Reference("artist_credit_name", "artist_credit", "artist_credit"),
    Reference("artist_credit_name", "artist", "artist"),
    Reference("recording", "artist_credit", "artist_credit"),
    Reference("isrc", "recording", "recording"),
    Reference("iswc", "work", "work"),
    Reference("l_recording_work", "entity0", "recording"),
    Reference("l_recording_work", "entity1", "work"),
    Reference("release", "release_group", "release_group"),
    Reference("medium", "release", "release"),
    Reference("track", "medium", "medium"),
    Reference("track", "recording", "recording"),
)
#: Tables that others refer to.
REFERRED = tuple(dict.fromkeys(r.target for r in REFERENCES if not r.own))


def stored_words(cat: Catalogue) -> DataFrame:
    """The bitmaps of all key columns, written once."""
    return shared_table(key_words(cat, REFERENCES), "keys")


def catalogue_keys(cat: Catalogue, words: DataFrame | None = None) -> DataFrame:
    """One row per key column; see ``key_report``.  A column of an empty table has none."""
    return key_report(key_words(cat, REFERENCES) if words is None else words)


def key_violations(cat: Catalogue, words: DataFrame | None = None) -> DataFrame:
    """One row per id that breaks the catalogue's contract; see ``violations``."""
    return violations(cat, REFERENCES, stored_words(cat) if words is None else words)
