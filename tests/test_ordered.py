"""Ordered exports over several files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from catalens.sources import ordered
from catalens.sources.ordered import export_ordered, manifest, read_ordered

SCHEMA = "id bigint, name string, list array<string>"


def rows(n, seed=1):
    rng = random.Random(seed)
    names = [None, "", "a", "b,c", 'q"q', "two\nlines", "é", "  pad "]
    return [(i, rng.choice(names), rng.choice([None, [], ["x", 'y"']])) for i in range(n)]


def back(spark, path, schema):
    return read_ordered(spark, path, schema).orderBy("file", "line").collect()


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_round_trip_in_order(spark, tmp_path, fmt):
    df = spark.createDataFrame(rows(500), SCHEMA).repartition(7)
    path = str(tmp_path / fmt)
    done = export_ordered(df, path, fmt, [F.asc_nulls_first("name"), "id"], rows_per_file=60)
    assert done == manifest(spark, path) and done.rows == 500
    assert len(done.files) > 8 and all(0 < n <= 60 for _, n in done.files)
    got = [tuple(r)[:3] for r in back(spark, path, df.schema)]
    assert got == sorted(rows(500), key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0]))


def test_ties_are_spread(spark, tmp_path):
    """All rows tie: they still come in several ranges, each row once."""
    df = spark.range(1000).selectExpr("id", "'same' as name")
    path = str(tmp_path / "t")
    done = export_ordered(df, path, "csv", ["name"], rows_per_file=100)
    assert all(n <= 100 for _, n in done.files) and len({name.split("-c0")[0] for name, _ in done.files}) >= 5
    assert sorted(r.id for r in back(spark, path, df.schema)) == list(range(1000))


def test_exports_again_and_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    export_ordered(spark.range(50), path, "parquet", ["id"], 20)
    export_ordered(spark.range(30), path, "parquet", [F.desc("id")], 20)
    assert [r.id for r in back(spark, path, spark.range(1).schema)] == list(range(29, -1, -1))
    done = export_ordered(spark.range(0), path, "parquet", ["id"])
    assert done.rows == 0 and back(spark, path, spark.range(1).schema) == []


def test_rejects(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        export_ordered(spark.range(1), str(tmp_path), "xlsx", ["id"])
    with pytest.raises(ValueError, match="positive"):
        export_ordered(spark.range(1), str(tmp_path), "csv", ["id"], 0)


def test_files_that_are_read_in_parts(spark, tmp_path):
    """Lines are numbered through where a file is split between tasks."""
    path = str(tmp_path / "t")
    export_ordered(spark.range(20_000).selectExpr("id", "repeat('x', 40) as name"), path, "json", ["id"], 30_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = read_ordered(spark, path, spark.range(1).selectExpr("id", "'' as name").schema)
        assert got.where("line <> id + 1").count() == 0 and got.rdd.getNumPartitions() >= 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ordered.SHEET_ROWS < 2**20
