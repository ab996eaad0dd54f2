"""Every registered query against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import pytest
from oracle_tools import assert_same, over_parquet

import __spark_entry__ as entry_point

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: query for name, query in entry_point.queries().items() if name in entry_point.BUILDERS}
ORACLE = entry_point.ORACLE


@pytest.fixture(scope="module")
def duck():
    return over_parquet(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert_same(QUERIES[name](spark, SF_DIR), duck, ORACLE[name])


def test_entry_returns_isrc_coverage(spark):
    (row,) = entry_point.entry(spark).collect()
    assert (row.total_recordings, row.recordings_with_isrc, row.unique_isrcs) == (1470, 540, 425)
    assert (row.duplicate_isrc_count, row.total_duplicate_recordings) == (125, 290)


def test_known_totals(spark):
    """Figures written down in FIXTURES.md before the operators existed."""

    def only(name):
        (row,) = QUERIES[name](spark, SF_DIR).collect()
        return row

    overview = {r.entity_type: r.total_count for r in QUERIES["stats_overview"](spark, SF_DIR).collect()}
    assert overview == {"Artists": 97, "Works": 200, "Recordings": 1500, "Releases": 200}
    assert only("party_missing_ids_artist").total_artists == 407
    assert only("party_missing_ids_artist_distinct").total_artists == 93
    assert only("work_without_recording").total_works == 751
    assert only("work_without_recording_distinct").works_without_recordings == 30
    audit = QUERIES["rec_on_release_without_work"](spark, SF_DIR).filter("scope_note <> 'SAMPLE_DATA'")
    (row,) = audit.collect()
    assert (row[0], row[1], row[2]) == (1017, 379, 638)
