"""Ordered exports in files of bounded length, for tools with a row limit.

Rows are dealt out by ranges of the order and sorted within them, so no task sorts them all;
a file never has more rows than asked for.  A manifest lists the files in order, with the rows
of each; it is written last and by rename, so a reader that finds one finds all its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.sources.keyed import Files
from catalens.sources.store import flattened, read_files, unflattened, write_options

#: What a spreadsheet holds, less its heading.
SHEET_ROWS = 1_048_575
MANIFEST = "manifest.json"


@dataclass(frozen=True)
class Manifest:
    fmt: str
    rows: int
    #: (file, rows) in order; files are names under the export's path.
    files: list[tuple[str, int]]


def export_ordered(
    df: DataFrame,
    path: str,
    fmt: str,
    order: Sequence[str | Column],
    rows_per_file: int = SHEET_ROWS,
) -> Manifest:
    """Write ``df`` in ``order`` to new files under ``path``, and the manifest that names them.

    Rows that ``order`` leaves tied are ordered by a hash of all their columns, so that many of
    them are no single range.  An export to the same path replaces the manifest; files of
    earlier exports stay until they are removed.
    """
    if rows_per_file < 1:
        raise ValueError(f"rows_per_file must be positive, got {rows_per_file}")
    spark, options = df.sparkSession, write_options(fmt)
    flat = flattened(df) if fmt == "csv" else df
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    # Hashed as text: equal rows tie, which changes nothing.
    tie = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    total = df.count()
    ranges = max(1, -(-total // rows_per_file))
    dealt = flat.repartitionByRange(ranges, *keys, tie).sortWithinPartitions(*keys, tie)
    folder = f"export-{uuid.uuid4().hex}"
    dealt.write.options(maxRecordsPerFile=rows_per_file, **options).format(fmt).save(f"{path}/{folder}")
    # A row for each file; names carry the number of the range and of the file within it.
    names = read_files(spark, f"{path}/{folder}", fmt, df.schema).groupBy(F.input_file_name().alias("file")).count().collect()
    counted = sorted((r.file.rsplit("/", 1)[1], r["count"]) for r in names)
    done = Manifest(fmt, sum(n for _, n in counted), [(f"{folder}/{name}", n) for name, n in counted])
    if done.rows != total:
        raise RuntimeError(f"{done.rows} rows were written of {total}")
    files = Files(spark, path)
    if MANIFEST in files.names(""):
        files.delete(MANIFEST)
    files.create(MANIFEST, json.dumps({"format": fmt, "rows": done.rows, "files": done.files}))
    return done


def manifest(spark: SparkSession, path: str) -> Manifest:
    found = json.loads(Files(spark, path).read(MANIFEST))
    return Manifest(found["format"], found["rows"], [(name, n) for name, n in found["files"]])


def read_ordered(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the latest export, with their ``file`` (from 1 on) and their ``line`` in it."""
    found = manifest(spark, path)
    if not found.files:
        return spark.createDataFrame([], schema).withColumns({"file": F.lit(0), "line": F.lit(0).cast("bigint")})
    place = {name.rsplit("/", 1)[1]: i for i, (name, _) in enumerate(found.files, 1)}
    listed = spark.createDataFrame(list(place.items()), "_name string, file int")
    rows = read_files(spark, [f"{path}/{name}" for name, _ in found.files], found.fmt, schema)
    named = rows.select(
        "*",
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # Parts of a file that is split lie in order of their blocks, rows in order within them.
    line = F.row_number().over(Window.partitionBy("_name").orderBy("_block", "_at"))
    numbered = named.withColumn("line", line.cast("bigint")).join(listed, "_name").drop("_name", "_block", "_at")
    return unflattened(numbered, schema)
