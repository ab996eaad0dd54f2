"""Loading, publishing, exporting and logging."""

from __future__ import annotations

import datetime as dt

import pytest
from oracle_tools import rows_of
from pyspark.sql import functions as F

from catalens import KPIS, load_catalogue, register
from catalens.functions.sampling import random_sample, seeded_top_k
from catalens.plans.flags import recording_facts
from catalens.plans import kpis
from catalens.sources import runlog, store
from catalens.sources.catalogue import ContractError, conform
from catalens.sources.contract import CONTRACT
from catalens.sources.derived import DerivedCatalogue

SF_DIR = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 5, 1, 12, 0)
LATER = dt.datetime(2024, 5, 2, 12, 0)


def test_catalogue_written_and_loaded_again(spark, tmp_path):
    derived = DerivedCatalogue(spark, SF_DIR)
    for name, df in derived.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    loaded = load_catalogue(spark, str(tmp_path))
    assert set(loaded) == set(CONTRACT)
    for name, df in loaded.items():
        assert df.columns == CONTRACT[name].names
    same = kpis.kpi_isrc_coverage(loaded, as_of=NOW).collect()
    assert same == kpis.kpi_isrc_coverage(derived, as_of=NOW).collect()
    plan = loaded["recording"].where("edits_pending = 0")._jdf.queryExecution().toString()
    assert "EqualTo(edits_pending,0)" in plan  # reaches the parquet scan


def test_missing_column_is_an_error(spark):
    with pytest.raises(ContractError, match="isrc: missing columns \\['recording'\\]"):
        conform(spark.createDataFrame([("a",)], "isrc string"), "isrc")


def test_unusable_type_is_an_error(spark):
    with pytest.raises(ContractError, match="recording is string, not bigint"):
        conform(spark.createDataFrame([("1", "a")], "recording string, isrc string"), "isrc")


def test_narrow_integers_and_extra_columns_are_accepted(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "recording int, isrc string, extra double")
    assert conform(df, "isrc").schema == CONTRACT["isrc"]


def test_register_publishes_and_replaces_views(spark, tmp_path):
    cat = DerivedCatalogue(spark, SF_DIR)
    facts = store.shared_table(recording_facts(cat), "recording_facts", str(tmp_path))
    for _ in range(2):
        names = register(spark, cat, as_of=NOW, recordings=facts)
    assert names == list(KPIS)
    assert {t.name for t in spark.catalog.listTables()} >= set(names)
    row = spark.sql("select * from confidence_recording").first()
    assert row.total_recordings == 1470 and row.calculated_at == NOW
    assert row.asDict() == kpis.confidence_recording(cat, as_of=NOW).first().asDict()
    assert all(kpi.description for kpi in KPIS.values())


def test_shared_table_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_table(spark.range(1), "x")


def test_upsert(spark):
    schema = "key string, value string, updated_at int"
    target = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], schema)
    updates = spark.createDataFrame([("b", "3", 2), ("c", "4", 2)], schema)
    got = {r["key"]: (r["value"], r["updated_at"]) for r in rows_of(store.upsert_by_key(target, updates, "key"))}
    assert got == {"a": ("1", 1), "b": ("3", 2), "c": ("4", 2)}
    empty = spark.createDataFrame([], schema)
    assert store.upsert_by_key(empty, updates, "key").count() == 2
    again = store.upsert_by_key(target, updates.union(spark.createDataFrame([("c", "5", 3)], schema)), "key", latest="updated_at")
    assert sorted(r["value"] for r in rows_of(again)) == ["1", "3", "5"]


def test_run_log_keeps_one_row_per_key(spark, tmp_path):
    path = str(tmp_path / "log")
    runlog.record(spark, path, {"schema_version": "1", "views_applied_at": "first"}, NOW)
    runlog.record(spark, path, {"views_applied_at": "second"}, LATER)
    runlog.record(spark, path, {"views_applied_at": "second"}, LATER)
    runlog.record_first(spark, path, {"views_applied_at": "third", "first_applied_at": "x"}, LATER)
    got = {r["key"]: (r["value"], r["updated_at"]) for r in rows_of(runlog.run_log(spark, path))}
    assert got == {"schema_version": ("1", NOW), "views_applied_at": ("second", LATER), "first_applied_at": ("x", LATER)}


def test_export_replaces_and_rejects(spark, tmp_path):
    df = spark.createDataFrame([(1, ['say "hi"', "b"]), (2, None)], "id bigint, names array<string>")
    for fmt in ("parquet", "csv", "json"):
        path = str(tmp_path / fmt)
        store.export(spark.range(5).withColumn("names", F.array()), path, fmt)
        store.export(df, path, fmt)
    assert sorted(spark.read.parquet(str(tmp_path / "parquet")).collect()) == sorted(df.collect())
    text = spark.read.options(header="true", escape='"', nullValue="\\N").csv(str(tmp_path / "csv"))
    assert {r.names for r in text.collect()} == {'["say \\"hi\\"","b"]', None}
    for fmt in ("parquet", "csv", "json"):
        back = store.read_export(spark, str(tmp_path / fmt), fmt, df.schema)
        assert sorted(back.collect()) == sorted(df.collect())
    with pytest.raises(ValueError, match="format"):
        store.export(df, str(tmp_path / "x"), "xlsx")


@pytest.mark.parametrize("partitions", [1, 4, 32])
def test_samples_do_not_depend_on_partitions(spark, partitions):
    df = spark.range(1000).selectExpr("id", "id % 3 as grade").repartition(partitions)
    got = [r.id for r in seeded_top_k(df, [F.col("grade")], ["id"], 20).collect()]
    again = [r.id for r in seeded_top_k(spark.range(1000).selectExpr("id", "id % 3 as grade"), [F.col("grade")], ["id"], 20).collect()]
    assert got == again and all(i % 3 == 0 for i in got) and len(set(got)) == 20
    other = [r.id for r in seeded_top_k(df, [F.col("grade")], ["id"], 20, seed=7).collect()]
    assert other != got


def test_random_sample_is_json_with_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    got = sorted(r.sample_data for r in random_sample(df).collect())
    assert got == ['{"id":1,"name":"a"}', '{"id":2,"name":null}']
    assert random_sample(df, 1).count() == 1
