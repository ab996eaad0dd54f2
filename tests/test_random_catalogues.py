"""All KPIs on small random catalogues with NULLs, orphans, repeats and hot keys.

A third of every link table points at one key, and a second run forces shuffled joins
with skewed partitions split, as on a cluster.
"""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from oracle_tools import assert_same

from __spark_entry__ import BUILDERS, comparable
from catalens.plans.kpis import KPIS
from catalens.sources.contract import CONTRACT
from oracle_queries import BODIES, sql

# The KPIs, and the reports that compute something of their own.
NAMES = [
    *KPIS,
    "work_recording_inconsistencies_distinct",
    "metadata_upsert",
    "recordings_without_isrc_list",
    "works_without_iswc_list",
    "low_confidence_artists",
    "flag_discrimination",
    "duplicate_risk_pivot",
    "artist_identifier_pivot",
    "data_checks",
]


def random_tables(seed: int) -> dict[str, list[dict]]:
    rnd = random.Random(seed)
    n = 60

    def some(low, high=None, null=0.0):
        return None if rnd.random() < null else rnd.randint(low, high)

    def key(high=n):
        """An id: a third of the time the hot one, now and then an orphan."""
        return 7 if rnd.random() < 1 / 3 else rnd.randint(1, high + 3)

    def text(*choices, null=0.0):
        return None if rnd.random() < null else rnd.choice(choices)

    def pending():
        return int(rnd.random() < 0.15)

    names = ["Blue", "blue", "Blue (Live)", "100%", "a_b", "back\\slash", "", "Ünder"]
    when = dt.datetime(2020, 1, 1)

    def entity(make, size=n):
        return [{"id": i, "gid": text(f"g{i}", null=0.1), **make()} for i in range(1, size + 1)]

    return {
        "artist": entity(
            lambda: {
                "name": text(*names),
                "sort_name": text(*names),
                "type": some(1, 2, null=0.1),
                "area": some(1, 9, null=0.3),
                "edits_pending": pending(),
            }
        ),
        "artist_ipi": [{"artist": key(), "ipi": text("1", "2", null=0.2)} for _ in range(30)],
        "artist_isni": [{"artist": key(), "isni": text("1", null=0.2)} for _ in range(20)],
        "url": [
            {"id": i, "url": text("viaf.org", "wikidata", "imdb viaf", "VIAF", "other", null=0.1)}
            for i in range(1, n + 1)
        ],
        "l_artist_url": [{"entity0": key(), "entity1": key()} for _ in range(60)],
        "artist_credit": [{"id": i, "name": text(*names, null=0.1)} for i in range(1, 31)],
        "artist_credit_name": [
            {"artist_credit": key(30), "position": 0, "artist": key()} for _ in range(60)
        ],
        "recording": entity(
            lambda: {
                "name": text(*names),
                "artist_credit": None if rnd.random() < 0.1 else key(30),
                "length": rnd.choice([None, 1000, 6000, 6001, 200000]),
                "comment": text("", "live", null=0.2),
                "edits_pending": pending(),
                "last_updated": when + dt.timedelta(days=rnd.randint(0, 3)),
            },
            120,
        ),
        "isrc": [
            {"recording": key(120), "isrc": text("HOT", "HOT", *map(str, range(25)), null=0.1)}
            for _ in range(120)
        ],
        "work": entity(
            lambda: {
                "name": text(*names, null=0.1),
                "type": some(1, 3, null=0.2),
                "comment": text("", "x"),
                "edits_pending": pending(),
                "last_updated": when,
            }
        ),
        "iswc": [
            {"work": key(), "iswc": text("HOT", *map(str, range(20)), null=0.1)} for _ in range(60)
        ],
        "l_recording_work": [{"entity0": key(120), "entity1": key()} for _ in range(90)],
        "release_group": [
            {"id": i, "name": text(*names), "type": some(1, 2, null=0.3)} for i in range(1, 11)
        ],
        "release": entity(
            lambda: {
                "name": text(*names),
                "release_group": some(1, 12, null=0.1),
                "status": some(1, 2, null=0.3),
                "edits_pending": pending(),
            }
        ),
        "medium": [{"id": i, "release": key()} for i in range(1, n + 1)],
        "track": [{"id": i, "medium": key(), "recording": key(120)} for i in range(1, 200)],
    }


DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "timestamp": "TIMESTAMP"}


def duck_catalogue(tables: dict[str, list[dict]]) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name, schema in CONTRACT.items():
        columns = ", ".join(f"{f.name} {DUCK_TYPES[f.dataType.simpleString()]}" for f in schema)
        con.execute(f"create table {name} ({columns})")
        rows = [[row.get(c) for c in schema.names] for row in tables[name]]
        marks = ", ".join("?" for _ in schema.names)
        con.executemany(f"insert into {name} values ({marks})", rows)
    return con


CLUSTER_LIKE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200b",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100b",
}


@pytest.fixture(scope="module", params=["plain", "cluster-like"])
def prepared(request, spark):
    settings = CLUSTER_LIKE if request.param == "cluster-like" else {}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    tables = random_tables(11 if settings else 5)
    cat = {}
    for name, schema in CONTRACT.items():
        rows = [tuple(row.get(c) for c in schema.names) for row in tables[name]]
        cat[name] = spark.createDataFrame(rows, schema).repartition(5)
    yield cat, duck_catalogue(tables)
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


@pytest.mark.parametrize("name", NAMES)
def test_kpi_on_random_catalogue(prepared, name):
    cat, duck = prepared
    assert_same(comparable(BUILDERS[name](cat)), duck, sql(BODIES[name], derived=False))
