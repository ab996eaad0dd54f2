"""Column contract of the sixteen catalogue tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _schema(columns: str) -> T.StructType:
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Table and column names of the catalogue.  `id` is a primary key
# wherever it occurs; the link and code tables are many-to-many.
CONTRACT: dict[str, T.StructType] = {
    "artist": _schema(
        "id bigint, gid string, name string, sort_name string, type int, area int, "
        "begin_date_year int, end_date_year int, edits_pending int"
    ),
    "artist_ipi": _schema("artist bigint, ipi string"),
    "artist_isni": _schema("artist bigint, isni string"),
    "url": _schema("id bigint, url string"),
    "l_artist_url": _schema("entity0 bigint, entity1 bigint"),
    "artist_credit": _schema("id bigint, name string"),
    "artist_credit_name": _schema("artist_credit bigint, position int, artist bigint"),
    "recording": _schema(
        "id bigint, gid string, name string, artist_credit bigint, length bigint, "
        "comment string, edits_pending int, last_updated timestamp"
    ),
    "isrc": _schema("recording bigint, isrc string"),
    "work": _schema(
        "id bigint, gid string, name string, type int, comment string, "
        "edits_pending int, last_updated timestamp"
    ),
    "iswc": _schema("work bigint, iswc string"),
    "l_recording_work": _schema("entity0 bigint, entity1 bigint"),
    "release_group": _schema("id bigint, name string, type int"),
    "release": _schema(
        "id bigint, gid string, name string, release_group bigint, status int, edits_pending int"
    ),
    "medium": _schema("id bigint, release bigint"),
    "track": _schema("id bigint, medium bigint, recording bigint"),
}

# The log of runs: one current row per key.
RUN_LOG = _schema("key string, value string, updated_at timestamp")
