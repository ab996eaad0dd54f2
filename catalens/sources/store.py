"""Writing results: exports, keyed upserts, and shared intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPTIONS = {
    "parquet": {},
    # Quotes inside a field are doubled, as spreadsheets expect; blanks at the ends stay,
    # and NULL is told from empty text.
    "csv": {
        "header": "true",
        "escape": '"',
        "ignoreLeadingWhiteSpace": "false",
        "ignoreTrailingWhiteSpace": "false",
        "nullValue": "\\N",
        "emptyValue": '""',
    },
    "json": {"ignoreNullFields": "false"},
}
_READ_OPTIONS = {"csv": {**_OPTIONS["csv"], "emptyValue": "", "multiLine": "true"}}


_NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_options(fmt: str) -> dict[str, str]:
    if fmt not in _OPTIONS:
        raise ValueError(f"format must be one of {sorted(_OPTIONS)}, got {fmt!r}")
    return _OPTIONS[fmt]


def flattened(df: DataFrame) -> DataFrame:
    """``df`` with arrays, maps and structs as JSON text, as CSV has none."""
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def export(df: DataFrame, path: str, fmt: str) -> None:
    """Replace ``path`` with ``df`` as parquet, csv or json.

    CSV has no arrays or structs, so those columns are written as JSON text.
    """
    options = write_options(fmt)
    rows = flattened(df) if fmt == "csv" else df
    rows.write.mode("overwrite").options(**options).format(fmt).save(path)


def read_files(spark: SparkSession, paths: str | list[str], fmt: str, schema: T.StructType) -> DataFrame:
    """Files of a frame with ``schema``; nested columns of CSV are still JSON text."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(paths)
    flat = [T.StructField(f.name, T.StringType()) if isinstance(f.dataType, _NESTED) else f for f in schema.fields]
    return spark.read.options(**_READ_OPTIONS["csv"]).schema(T.StructType(flat)).csv(paths)


def read_export(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """What ``export`` wrote of a frame with ``schema``."""
    return unflattened(read_files(spark, path, fmt, schema), schema)


def unflattened(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Nested columns of ``schema`` that are JSON text in ``rows``, as they were."""
    return rows.select(
        *[
            F.from_json(f.name, f.dataType).alias(f.name)
            if isinstance(f.dataType, _NESTED) and isinstance(rows.schema[f.name].dataType, T.StringType)
            else F.col(f.name)
            for f in schema.fields
        ],
        *[F.col(c) for c in rows.columns if c not in schema.names],
    )


def upsert_by_key(
    target: DataFrame, updates: DataFrame, key: str | Sequence[str], latest: str | None = None
) -> DataFrame:
    """``target`` with each update inserted, or put in place of the row of the same key.

    Keys must be unique in ``updates``; where they may repeat, name the column whose
    greatest value wins as ``latest``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if latest is not None:
        rest = [c for c in updates.columns if c not in keys and c != latest]
        newest = updates.groupBy(*keys).agg(F.max(F.struct(latest, *rest)).alias("_newest"))
        updates = newest.select(*keys, "_newest.*").select(*updates.columns)
    # NULL keys match each other, so a key is never there twice.
    fresh = updates.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return target.join(fresh, same, "left_anti").unionByName(updates)


def shared_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written once to a folder all executors share, and read back.

    Used for a frame that many KPIs read: the lineage ends here, so a lost executor
    costs a re-read of a file rather than the whole computation.
    """
    path = f"{shared_folder(df.sparkSession, folder)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """``folder``, else the session's spark.checkpoint.dir, else its warehouse: folders that
    all executors share."""
    for name in ("spark.checkpoint.dir", "spark.sql.warehouse.dir"):
        folder = folder or spark.conf.get(name, None)
    if not folder:
        raise ValueError("spark.checkpoint.dir names no shared folder for intermediate tables")
    return folder.rstrip("/")
