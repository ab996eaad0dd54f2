"""Summaries over tables stored by recording: same figures, no exchange on the recording."""

from __future__ import annotations

import re

import pytest

from catalens.operators.colocated import StoredLinks, store_by_key
from catalens.operators.confidence import confidence
from catalens.plans import kpis
from catalens.plans.stored import RecordingStore
from catalens.sources.derived import DerivedCatalogue

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stored(spark):
    return RecordingStore.store(DerivedCatalogue(spark, SF_DIR), buckets=4)


@pytest.fixture
def shuffled_joins(spark):
    """As at scale: no side is small enough to be broadcast by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("entity", list(kpis.CONFIDENCE))
def test_same_figures(spark, stored, entity, shuffled_joins):
    plain = confidence(kpis.ENTITY_FLAGS[entity](stored.cat, None), kpis.CONFIDENCE[entity])
    assert stored.summary(entity).collect() == plain.collect()


@pytest.mark.parametrize("entity", list(kpis.CONFIDENCE))
def test_no_exchange_on_the_recording(stored, entity, shuffled_joins):
    plan = stored.summary(entity)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    names = {re.sub(r"#\d+L?", "", k).split(",")[0] for k in keys}
    assert not names & {"recording", "entity0"}, names
    recording_ids = {m for m in re.findall(r"FileScan parquet [\w.]*facts\w*\[(id#\d+L?)", plan)}
    assert not any(i in k for i in recording_ids for k in keys)
    if entity in ("work", "release"):
        assert "SortMergeJoin" in plan and len(keys) > 0


def test_heavy_keys_lie_apart(spark, shuffled_joins):
    """Half of the rows have one key: they are no bucket's, and the join is the join."""
    links = spark.range(1000).selectExpr("if(id % 2 = 0, 5, id) as k", "id as x").union(spark.range(3).selectExpr("cast(null as bigint)", "id"))
    facts = spark.range(0, 900, 3).selectExpr("id", "id * 10 as v").union(spark.createDataFrame([(5, 55)], "id bigint, v bigint"))
    stored = StoredLinks.store(links, "k", "links", buckets=8)
    few = store_by_key(facts, "id", "few", buckets=8)
    assert [r.k for r in stored.heavy_keys.collect()] == [5]
    assert stored.heavy.count() == 501 and stored.light.count() == 499
    expected = links.join(facts, links.k == facts.id).select("k", "x", "v").collect()
    joined = stored.joined(few, "id", "v")
    assert sorted(joined.collect()) == sorted(expected)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan


def test_stored_again(spark):
    """Every store is a table of its own."""
    df = spark.range(10).selectExpr("id")
    one, two = store_by_key(df, "id", "again", 2), store_by_key(df.limit(3), "id", "again", 2)
    assert (one.count(), two.count()) == (10, 3)
