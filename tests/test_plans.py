"""Confidence roll-ups against nested EXISTS, empty catalogues, and plan shapes."""

from __future__ import annotations

import re

import pytest
from oracle_tools import rows_of

from catalens.plans import checks, flags, kpis, reports
from catalens.sources.derived import DerivedCatalogue

SF_DIR = "/root/testdata/sf0.001"

HAS_ID = """(exists (select 1 from artist_isni x where x.artist = n.artist)
    or exists (select 1 from artist_ipi y where y.artist = n.artist))"""


@pytest.fixture(scope="module")
def cat(spark):
    return DerivedCatalogue(spark, SF_DIR)


def test_work_flags_equal_nested_exists(spark, cat):
    for name, df in cat.items():
        df.createOrReplaceTempView(name)
    literal = spark.sql(f"""
        select w.id,
          int(exists (select 1 from iswc i where i.work = w.id and i.iswc is not null)) as has_iswc,
          int(exists (select 1 from l_recording_work l join recording r on r.id = l.entity0
            join isrc i on i.recording = r.id
            where l.entity1 = w.id and i.isrc is not null)) as has_isrc,
          int(exists (select 1 from l_recording_work l join recording r on r.id = l.entity0
            join artist_credit_name n on n.artist_credit = r.artist_credit
            where l.entity1 = w.id and {HAS_ID})) as has_artist_id,
          int(exists (select 1 from l_recording_work l join track t on t.recording = l.entity0
            join medium m on m.id = t.medium where l.entity1 = w.id)) as on_release
        from work w where w.edits_pending = 0""")
    columns = ["id", "has_iswc", "has_isrc", "has_artist_id", "on_release"]
    ours = flags.work_flags(cat).select(*columns)
    assert sorted(ours.collect()) == sorted(literal.select(*columns).collect())


def test_shared_recording_facts_change_nothing(cat):
    facts = flags.recording_facts(cat)
    alone = sorted(map(tuple, reports.confidence_levels(cat).collect()))
    assert sorted(map(tuple, reports.confidence_levels(cat, facts).collect())) == alone


def test_release_flags_take_real_columns(make_catalogue):
    cat = make_catalogue(
        release=[{"id": 1, "release_group": 1}, {"id": 2, "release_group": 2, "status": 1}],
        release_group=[{"id": 1, "type": 3}],
    )
    proxy = {r["id"]: (r["has_date"], r["has_country"]) for r in rows_of(flags.release_flags(cat))}
    assert proxy == {1: (1, 0), 2: (0, 1)}
    named = flags.release_flags(cat, has_date="id = 2", has_country="true")
    assert {r["id"]: (r["has_date"], r["has_country"]) for r in rows_of(named)} == {1: (0, 1), 2: (1, 1)}


def test_linked_rows_count_even_when_unsettled(make_catalogue):
    cat = make_catalogue(
        work=[{"id": 1}, {"id": 2}],
        recording=[{"id": 10, "edits_pending": 1}, {"id": 11}],
        isrc=[{"recording": 10, "isrc": "A"}, {"recording": 11, "isrc": None}],
        l_recording_work=[{"entity0": 10, "entity1": 1}, {"entity0": 11, "entity1": 2}],
    )
    got = {r["id"]: r["has_isrc"] for r in rows_of(flags.work_flags(cat))}
    assert got == {1: 1, 2: 0}  # a NULL code is no code


def test_track_rows_multiply_work_counts(make_catalogue):
    """The same recording twice on one release lists its works twice."""
    cat = make_catalogue(
        recording=[{"id": 1, "name": "r"}, {"id": 2, "name": "s"}],
        release=[{"id": 5, "name": "x"}],
        medium=[{"id": 6, "release": 5}],
        track=[{"id": i, "medium": 6, "recording": rec} for i, rec in enumerate([1, 1, 2])],
        work=[{"id": 8, "name": "b"}, {"id": 9, "name": "a"}],
        l_recording_work=[{"entity0": 1, "entity1": 8}, {"entity0": 1, "entity1": 9}],
    )
    got = {r["recording_id"]: r for r in rows_of(kpis.rec_on_release_without_work_samples(cat))}
    assert got[1]["work_count"] == 4 and got[1]["associated_works"] == ["a", "a", "b", "b"]
    assert got[2]["work_count"] == 0 and got[2]["associated_works"] is None
    shares = rows_of(kpis.work_recording_inconsistencies(cat))
    assert {r["inconsistency_type"]: r["count"] for r in shares} == {
        "Recordings without Works": 1,
        "Works without Recordings": 0,
    }


def test_empty_catalogue(make_catalogue):
    cat = make_catalogue()
    for name, kpi in kpis.KPIS.items():
        rows = rows_of(kpi.build(cat))
        if name.endswith("_samples") or name in ("kpi_iswc_detailed", "dup_isrc_candidates"):
            assert rows == [], name
        for row in rows:
            assert all(not v for k, v in row.items() if k.startswith("total_")), name
            assert all(v is None for k, v in row.items() if k.endswith("_pct")), name
    verdicts = {r["check"]: r["status"] for r in rows_of(checks.data_checks(cat))}
    assert verdicts["recordings loaded"] == "fail"
    assert verdicts["Artist: population not empty"] == "fail"
    assert verdicts["Artist: phase1 counts sum to total"] == "ok"


def test_checks_on_the_test_catalogue(cat):
    verdicts = {r["check"]: r["status"] for r in rows_of(checks.data_checks(cat))}
    assert verdicts.pop("recordings loaded") == "warn"
    assert set(verdicts.values()) == {"ok"}
    few = checks.data_checks(cat, expected_recordings=1500)
    assert {r["check"]: r["status"] for r in rows_of(few)}["recordings loaded"] == "ok"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_multiplies_rows(cat):
    for name, kpi in kpis.KPIS.items():
        plan = plan_of(kpi.build(cat))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan, name


def test_groups_are_cut_before_the_shuffle(cat):
    """Ranked rows per code are limited on the sending side too."""
    plan = plan_of(kpis.dup_isrc_candidates(cat))
    assert re.search(r"WindowGroupLimit \[isrc.*, 3, Partial", plan)
    listing = plan_of(kpis.dup_isrc_candidates_samples(cat))
    assert re.search(r"WindowGroupLimit \[isrc.*, 100, Partial", listing)


def test_samples_are_top_k_not_sorts(cat):
    for name, kpi in kpis.KPIS.items():
        if name.endswith("_samples"):
            plan = plan_of(kpi.build(cat))
            assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan, name


def test_confidence_reads_only_what_it_needs(cat):
    plan = plan_of(kpis.confidence_artist(cat))
    for unused in ("p_name", "o_orderdate", "l_extendedprice", "s_name"):
        assert unused not in plan
