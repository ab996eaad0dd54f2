"""Hot keys, shared work, and inputs that outgrow a first guess."""

from __future__ import annotations

import datetime as dt
import re
from contextlib import contextmanager

import pytest
from oracle_tools import rows_of

from catalens.operators.evidence import Evidence, observe
from catalens.operators.identifiers import presence_profile
from catalens.operators.skew import heavy_keys, salted_join
from catalens.plans import flags, kpis, reports
from catalens.plans.publish import publish
from catalens.sources import runlog, store
from catalens.sources.catalogue import ContractError, conform
from catalens.sources.derived import SOURCES, DerivedCatalogue

SF_DIR = "/root/testdata/sf0.001"


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


@pytest.fixture
def hot(make_catalogue):
    """One credit, artist, work, recording, ISRC and ISWC holding half of the rows each."""
    n = range(1, 101)
    one = lambda i: 1 if i % 2 else i
    return make_catalogue(
        artist=[{"id": i, "type": 1, "name": "a"} for i in n],
        artist_isni=[{"artist": i} for i in n],
        artist_credit=[{"id": i, "name": "c"} for i in n],
        artist_credit_name=[{"artist_credit": i, "artist": one(i)} for i in n],
        recording=[{"id": i, "artist_credit": one(i), "name": "r"} for i in n],
        isrc=[{"recording": i, "isrc": f"I{one(i)}"} for i in n],
        work=[{"id": i, "name": "w"} for i in n],
        iswc=[{"work": i, "iswc": f"T{one(i)}"} for i in n],
        l_recording_work=[{"entity0": i, "entity1": one(i)} for i in n],
        release=[{"id": i} for i in n],
        medium=[{"id": i, "release": i} for i in n],
        track=[{"id": i, "recording": one(i), "medium": i} for i in n],
    )


@pytest.mark.parametrize(
    ("key", "build"),
    [
        ("artist", flags._identified_credits),
        ("artist_credit", flags.recording_facts),
        ("artist_credit", flags.artist_flags),
        ("entity1", flags.recording_facts),
        ("recording", flags.release_flags),
        ("isrc", kpis.kpi_isrc_coverage_samples),
        ("iswc", kpis.kpi_iswc_coverage_samples),
        ("iswc", kpis.kpi_iswc_detailed),
    ],
)
def test_hot_keys_are_salted(spark, hot, key, build):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        df = build(hot)
        assert re.search(rf"Join \[{key}#\d+L?, _salt#\d+L?\]", plan_of(df)), plan_of(df)
        assert df.count() > 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_is_the_join(spark, how):
    many = spark.range(300).selectExpr("id", "case when id % 5 = 0 then null when id % 2 = 0 then 0 else id % 40 end as k", "if(id % 7 = 0, null, 1) as x")
    few = spark.range(0, 60, 2).selectExpr("id as k", "id * 10 as v")
    for parts in (None, 2, 50):
        assert sorted(salted_join(many, few, "k", how, ["id"], parts=parts).collect(), key=str) == sorted(many.join(few, "k", how).collect(), key=str)
    names = many.selectExpr("id", "concat('n', k) as k"), few.selectExpr("concat('n', k) as k", "v")
    assert sorted(salted_join(*names, "k", how, ["id"]).collect(), key=str) == sorted(names[0].join(names[1], "k", how).collect(), key=str)


def test_heavy_keys_are_those_above_an_even_part(spark):
    """A third of the rows, a tenth, and keys of one row each, dealt to 100 parts."""
    rows = spark.range(30_000).selectExpr("case when id % 3 = 0 then -1 when id % 10 = 1 then -2 else id end as k")
    expected = {r.k: r["count"] for r in rows.groupBy("k").count().where("count > 300").collect()}
    got = {r.k: r._parts for r in heavy_keys(rows, "k", 100).collect()}
    assert got == {k: -(-n * 100 // 30_000) for k, n in expected.items()} and set(got) == {-1, -2}
    assert heavy_keys(spark.range(1000).selectExpr("id as k"), "k", 100).collect() == []
    assert heavy_keys(spark.range(0).selectExpr("id as k"), "k").collect() == []
    assert heavy_keys(spark.range(9).selectExpr("cast(null as string) as k"), "k").collect() == []


def test_more_rows_need_more_parts_and_others_none(spark):
    """A hot key is spread over as many parts as it fills, and only its row of the narrow side
    is copied."""
    from pyspark.sql import functions as F

    many = spark.range(100_000).selectExpr("id", "if(id % 3 = 0, 7, id) as k")
    few = spark.range(1000).selectExpr("id as k", "id as v")
    for parts in (10, 100):
        with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false", spark__sql__shuffle__partitions=str(parts)):
            joined = salted_join(many, few, "k", "inner", ["id"])
            sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == many.join(few, "k").count()
            # The hot key's rows meet in several partitions, none of which holds most of them.
            assert max(sizes) < 0.62 * sum(sizes) if parts == 10 else max(sizes) < 0.12 * sum(sizes)
            plan = joined._jdf.queryExecution().analyzed().toString()
            assert plan.count("approx_top_k") >= 1
    copies = heavy_keys(many, "k", 100).agg(F.sum("_parts")).first()[0]
    assert copies <= 100  # rows the narrow side gains, of a thousand


def test_confidence_report_reads_the_facts_once(spark):
    cat = DerivedCatalogue(spark, SF_DIR)
    assert final_plan(reports.confidence_levels(cat)).count("FileScan") <= 26


def test_samples_are_planned_once(spark):
    cat = DerivedCatalogue(spark, SF_DIR)
    for name in ("rec_on_release_without_work_samples", "work_without_recording_samples", "confidence_work_samples", "confidence_recording_samples"):
        plan = plan_of(kpis.KPIS[name].build(cat)).split("== Initial Plan ==")[0]
        # The sample itself, and the final order of its described rows.
        assert plan.count("TakeOrderedAndProject") == 2, name


def test_gap_lists_look_at_all_gaps(make_catalogue):
    """A thousand shared codes crowd a twenty-row sample; the one gap is listed all the same."""
    n = range(2, 1000)
    cat = make_catalogue(
        artist=[{"id": 1, "type": 1, "name": "a"}],
        artist_credit=[{"id": 1}],
        artist_credit_name=[{"artist_credit": 1, "artist": 1}],
        recording=[{"id": 1, "artist_credit": 1, "name": "gap"}, *({"id": i, "artist_credit": 1} for i in n)],
        isrc=[{"recording": i, "isrc": "same"} for i in n],
        work=[{"id": 1, "name": "gap"}, *({"id": i} for i in n)],
        iswc=[{"work": i, "iswc": "same"} for i in n],
    )
    assert [r["recording_name"] for r in rows_of(reports.recordings_without_isrc(cat))] == ["gap"]
    assert [r["work_name"] for r in rows_of(reports.works_without_iswc(cat))] == ["gap"]


def test_linked_names_of_rows_that_have_some(make_catalogue):
    """Every recording is linked, so the sampled rows do list works."""
    n = range(1, 80)
    cat = make_catalogue(
        recording=[{"id": i, "name": f"r{i % 3}"} for i in n],
        release=[{"id": 1}],
        medium=[{"id": 1, "release": 1}],
        track=[{"id": i, "medium": 1, "recording": i} for i in n],
        work=[{"id": i, "name": f"w{i % 5}"} for i in range(1, 9)],
        l_recording_work=[{"entity0": i, "entity1": w} for i in n for w in (1 + i % 8, 1 + i % 3)],
    )
    got = rows_of(kpis.rec_on_release_without_work_samples(cat))
    assert len(got) == 50
    for r in got:
        i = r["recording_id"]
        assert r["associated_works"] == sorted(f"w{w % 5}" for w in (1 + i % 8, 1 + i % 3))
    for r in rows_of(kpis.work_without_recording_samples(cat)):
        own = sorted(f"r{i % 3}" for i in n for w in (1 + i % 8, 1 + i % 3) if w == r["work_id"])
        assert r["associated_recordings"] == own and r["recording_count"] == len(own)


def test_more_flags_than_one_mask_holds(spark):
    entity = spark.range(3)
    rows = [Evidence(spark.range(1, 2).selectExpr("id as k"), "k", {f"f{i}": None if i % 2 else f"{i} > 66" for i in range(130)})]
    got = {r["id"]: r for r in rows_of(observe(entity, rows))}
    assert all(got[1][f"f{i}"] == (i % 2 or i > 66) for i in range(130))
    assert not any(got[0][f"f{i}"] for i in range(130))


def test_profile_of_an_artist_with_millions_of_links(spark):
    df = spark.createDataFrame([(1, 3_000_000)], "has int, urls bigint")
    (row,) = presence_profile(df, ["has"], "artists", fanout={"urls": 3}).collect()
    assert row.total_artists == 27 * 10**18 and row.artists_missing_has == 27 * 10**18 - 1


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_exports_keep_texts_as_they_are(spark, tmp_path, fmt):
    texts = ["  pad ", "two\nlines", "carriage\r\nreturn", "", None, 'a "quote", and', "\ttab\t", ";,|"]
    df = spark.createDataFrame([(i, t, [t or "x"]) for i, t in enumerate(texts)], "id bigint, name string, list array<string>")
    store.export(df, str(tmp_path / fmt), fmt)
    back = store.read_export(spark, str(tmp_path / fmt), fmt, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_null_keys_are_replaced_like_others(spark):
    schema = "key string, value string"
    target = spark.createDataFrame([(None, "1"), ("a", "1")], schema)
    updates = spark.createDataFrame([(None, "2")], schema)
    assert sorted(map(tuple, store.upsert_by_key(target, updates, "key").collect()), key=str) == [("a", "1"), (None, "2")]


def test_times_are_conformed(spark):
    rows = spark.range(1).selectExpr(
        "cast(1 as bigint) as id", "'g' as gid", "'n' as name", "1 as artist_credit", "1 as length", "'' as comment",
        "0 as edits_pending", "date '2024-01-02' as last_updated",
    )
    out = conform(rows, "recording")
    assert dict(out.dtypes)["last_updated"] == "timestamp"
    assert out.first().last_updated == dt.datetime(2024, 1, 2)


def test_missing_source_column_is_an_error(spark, tmp_path):
    spark.range(1).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    assert "c_name" in SOURCES["customer"]
    with pytest.raises(ContractError, match="c_name"):
        DerivedCatalogue(spark, str(tmp_path))["artist"]


def test_publish_twice(spark, tmp_path):
    for name, df in DerivedCatalogue(spark, SF_DIR).items():
        df.write.parquet(str(tmp_path / "cat" / f"{name}.parquet"))
    log, now = str(tmp_path / "log"), dt.datetime(2024, 5, 1)
    first = publish(spark, str(tmp_path / "cat"), log, now, expected_recordings=1)
    again = publish(spark, str(tmp_path / "cat"), log, now + dt.timedelta(1), scope_note="mine", expected_recordings=1)
    assert first.views == again.views == list(kpis.KPIS) and again.failed == []
    assert spark.table("kpi_isrc_coverage").first().scope_note == "mine"
    got = {r["key"]: r["value"] for r in rows_of(runlog.run_log(spark, log))}
    assert got["views_applied_at"] == "2024-05-02T00:00:00" and got["failed_checks"] == ""


def test_failing_check_is_reported(spark, make_catalogue, tmp_path):
    for name, df in make_catalogue().items():
        df.write.parquet(str(tmp_path / "cat" / f"{name}.parquet"))
    done = publish(spark, str(tmp_path / "cat"), str(tmp_path / "log"), dt.datetime(2024, 5, 1))
    assert "recordings loaded" in done.failed
