"""Committed merges into stored tables."""

from __future__ import annotations

import glob
import os
import random

import pytest
from oracle_tools import rows_of
from pyspark.sql import types as T

from catalens.sources import keyed
from catalens.sources.keyed import ConcurrentUpdate, DuplicateKey, KeyedTable

SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.StringType()), T.StructField("at", T.IntegerType())])


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def found(df):
    return {r["key"]: (r["value"], r["at"]) for r in rows_of(df)}


def files(table, folders):
    return {f: os.stat(f).st_mtime_ns for folder in folders for f in glob.glob(f"{table.path}/{folder}/*.parquet")}


def test_two_merges_and_all_versions(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=8)
    assert found(table.read()) == {} and table.versions() == [0]
    table.upsert(rows(spark, *[(i, f"v{i}", 1) for i in range(50)]))
    table.upsert(rows(spark, (3, "new", 2), (77, "added", 2), (None, "null key", 2)))
    table.upsert(rows(spark, (None, "again", 3)))
    expected = {i: (f"v{i}", 1) for i in range(50)}
    assert found(table.read(1)) == expected
    expected |= {3: ("new", 2), 77: ("added", 2), None: ("null key", 2)}
    assert found(table.read(2)) == expected
    assert found(KeyedTable(spark, table.path).read()) == expected | {None: ("again", 3)}
    assert table.read().count() == 52


def test_untouched_buckets_are_not_written(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=16)
    before = table.upsert(rows(spark, *[(i, "old", 1) for i in range(200)]))
    times = files(table, before.folders.values())
    after = table.upsert(rows(spark, (5, "new", 2)))
    changed = [b for b in after.folders if after.folders[b] != before.folders.get(b)]
    assert len(before.folders) == 16 and len(changed) == 1
    kept = [f for b, f in after.folders.items() if b not in changed]
    assert files(table, kept) == {f: t for f, t in times.items() if any(f"/{k}/" in f for k in kept)}


def test_only_touched_buckets_are_read(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=16)
    base = table.upsert(rows(spark, *[(i, "old", 1) for i in range(200)]))
    bucket = spark.createDataFrame([(5,)], "key bigint").select(table._bucket()).first()[0]
    for b, folder in base.folders.items():
        if b != bucket:  # a merge that read them would fail
            for f in glob.glob(f"{table.path}/{folder}/*.parquet"):
                os.rename(f, f + ".away")
    table.upsert(rows(spark, (5, "new", 2)))


def test_insert_if_absent(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=4)
    table.upsert(rows(spark, (1, "a", 1)))
    table.add_missing(rows(spark, (1, "b", 2), (2, "c", 2)))
    assert found(table.read()) == {1: ("a", 1), 2: ("c", 2)}


def test_repeated_keys(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=4)
    twice = rows(spark, (1, "a", 1), (1, "b", 2), (2, "c", 1))
    with pytest.raises(DuplicateKey):
        table.upsert(twice)
    assert table.versions() == [0] and glob.glob(f"{table.path}/data/*") == []
    table.upsert(twice, latest="at")
    assert found(table.read()) == {1: ("b", 2), 2: ("c", 1)}


def test_no_updates_no_version(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key")
    assert table.upsert(rows(spark)).number == 0


class Meddler(KeyedTable):
    """Lets others commit in between."""

    def __init__(self, spark, path, others):
        super().__init__(spark, path)
        self.others = others

    def _rows(self, folders):
        if self.others:
            self.others.pop()()
        return super()._rows(folders)


def test_the_writer_that_comes_second_starts_again(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=2)
    table.upsert(rows(spark, (1, "a", 1)))
    other = lambda k: lambda: KeyedTable(spark, table.path).upsert(rows(spark, (k, "other", 2)))
    Meddler(spark, table.path, [other(1), other(9)]).upsert(rows(spark, (1, "mine", 3), (2, "mine", 3)))
    assert found(table.read()) == {1: ("mine", 3), 2: ("mine", 3), 9: ("other", 2)}
    assert table.versions() == [0, 1, 2, 3, 4]


def test_a_writer_that_is_never_first_gives_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "ATTEMPTS", 2)
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=1)
    other = lambda: KeyedTable(spark, table.path).upsert(rows(spark, (1, "other", 2)))
    with pytest.raises(ConcurrentUpdate):
        Meddler(spark, table.path, [other, other, other]).upsert(rows(spark, (1, "mine", 3)))
    assert found(table.read()) == {1: ("other", 2)}


def test_a_writer_that_dies_leaves_the_version(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=2)
    table.upsert(rows(spark, (1, "a", 1)))

    def die(*_):
        raise RuntimeError("died")

    broken = KeyedTable(spark, table.path)
    monkeypatch.setattr(broken._files, "create", die)
    with pytest.raises(RuntimeError, match="died"):
        broken.upsert(rows(spark, (1, "b", 2)))
    assert found(table.read()) == {1: ("a", 1)}
    table.upsert(rows(spark, (1, "c", 3)))
    assert found(table.read()) == {1: ("c", 3)}


def test_expire_keeps_what_versions_name(spark, tmp_path):
    table = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=4)
    for i in range(4):
        table.upsert(rows(spark, (i, f"v{i}", i), (100, "all", i)))
    everything = found(table.read())
    assert table.expire(keep=2) == [0, 1, 2]
    assert table.versions() == [3, 4] and found(table.read()) == everything
    assert found(table.read(3)) == {k: v for k, v in everything.items() if k not in (3, 100)} | {100: ("all", 2)}


def test_opening(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable.open_or_create(spark, path, SCHEMA, ["key", "at"], 3)
    again = KeyedTable.open_or_create(spark, path, SCHEMA, ["key"], 99)
    assert (again.keys, again.buckets, again.schema) == (table.keys, 3, SCHEMA)
    with pytest.raises(ConcurrentUpdate):
        KeyedTable.create(spark, path, SCHEMA, "key")
    with pytest.raises(ValueError, match="no columns"):
        KeyedTable.create(spark, str(tmp_path / "u"), SCHEMA, "id")


def test_random_merges_equal_a_dictionary(spark, tmp_path):
    rng = random.Random(2)
    table, expected = KeyedTable.create(spark, str(tmp_path / "t"), SCHEMA, "key", buckets=5), {}
    for at in range(5):
        batch = {rng.choice([None, *range(30)]): (rng.choice("abc"), at) for _ in range(12)}
        values = rows(spark, *[(k, *v) for k, v in batch.items()])
        if at % 2:
            table.add_missing(values)
            expected = batch | expected
        else:
            table.upsert(values)
            expected |= batch
    assert found(table.read()) == expected
