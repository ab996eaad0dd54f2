"""Planted violations of the catalogue's keys."""

from __future__ import annotations

import datetime as dt
import random

from oracle_tools import rows_of

from catalens.operators.integrity import Reference, key_report, key_words, violations
from catalens.plans import integrity
from catalens.plans.publish import publish


def found(df):
    return sorted((r["table_name"], r["column_name"], r["problem"], r["id"], r["rows"]) for r in rows_of(df))


def test_planted_violations(make_catalogue):
    cat = make_catalogue(
        artist=[{"id": 1}, {"id": 1}, {"id": 1}, {"id": 64}, {"id": None}, {"id": -5}],
        artist_isni=[{"artist": 1}, {"artist": 2}, {"artist": 2}, {"artist": None}, {"artist": -5}, {"artist": 2**62}],
        recording=[{"id": 10, "artist_credit": 7}, {"id": 11, "artist_credit": None}],
        artist_credit=[{"id": 6}],
        track=[{"id": 1, "recording": 10, "medium": 99}],
    )
    assert sorted(found(integrity.key_violations(cat)), key=repr) == sorted(
        [
            ("artist", "id", "null id", None, 1),
            ("artist", "id", "repeated id", 1, 3),
            ("artist_isni", "artist", "missing id", 2, None),
            ("artist_isni", "artist", "missing id", 2**62, None),
            ("recording", "artist_credit", "missing id", 7, None),
            ("track", "medium", "missing id", 99, None),
        ],
        key=repr,
    )
    report = {(r["table_name"], r["column_name"]): r for r in rows_of(integrity.catalogue_keys(cat))}
    own = report["artist", "id"]
    assert (own["row_count"], own["null_rows"], own["distinct_ids"], own["repeated_rows"], own["missing_ids"]) == (6, 1, 3, 2, 0)
    link = report["artist_isni", "artist"]
    assert (link["row_count"], link["null_rows"], link["distinct_ids"], link["repeated_rows"], link["missing_ids"]) == (6, 1, 4, 0, 2)
    assert ("isrc", "recording") not in report


def test_a_clean_and_an_empty_catalogue(make_catalogue):
    assert found(integrity.key_violations(make_catalogue())) == []
    assert integrity.catalogue_keys(make_catalogue()).collect() == []
    cat = make_catalogue(artist=[{"id": i} for i in range(200)], artist_ipi=[{"artist": i % 200} for i in range(500)])
    assert found(integrity.key_violations(cat)) == []


def test_random_keys_against_sets(spark):
    rng = random.Random(3)
    ids = [rng.choice([None, rng.randrange(-100, 200), rng.randrange(10**12)]) for _ in range(300)]
    refs = [rng.choice([None, *ids, rng.randrange(-100, 200)]) for _ in range(400)]
    tables = {"a": spark.createDataFrame([(i,) for i in ids], "id bigint"), "b": spark.createDataFrame([(i,) for i in refs], "a bigint")}
    keys = (Reference("a", "id", "a"), Reference("b", "a", "a"))
    words = key_words(tables, keys)
    expected = [("b", "a", "missing id", i, None) for i in {*refs} - {*ids} - {None}]
    expected += [("a", "id", "repeated id", i, ids.count(i)) for i in {*ids} - {None} if ids.count(i) > 1]
    expected += [("a", "id", "null id", None, ids.count(None))]
    assert sorted(found(violations(tables, keys, words)), key=repr) == sorted(expected, key=repr)
    report = {r["table_name"]: r for r in rows_of(key_report(words))}
    assert report["b"]["distinct_ids"] == len({*refs} - {None}) and report["b"]["missing_ids"] == len({*refs} - {*ids} - {None})


def test_each_table_is_scanned_once(spark, tmp_path, make_catalogue):
    cat = make_catalogue(recording=[{"id": 1, "artist_credit": 1}], artist_credit=[{"id": 1}], track=[{"id": 1, "recording": 1, "medium": 1}])
    stored = {}
    for name, df in cat.items():
        df.write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    plan = integrity.catalogue_keys(stored)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == len(stored)


def test_publishing_reports_broken_keys(spark, make_catalogue, tmp_path):
    cat = make_catalogue(
        artist=[{"id": 1, "type": 1}, {"id": 1, "type": 1}],
        artist_credit=[{"id": 1}],
        recording=[{"id": 1, "artist_credit": 5}],
        track=[{"id": 1, "medium": 1, "recording": 1}] * 2,
    )
    for name, df in cat.items():
        df.write.parquet(str(tmp_path / "cat" / f"{name}.parquet"))
    done = publish(spark, str(tmp_path / "cat"), str(tmp_path / "log"), dt.datetime(2024, 5, 1))
    assert done.checks["artist.id holds each id once"] == "fail"
    assert done.checks["track.id holds each id once"] == "warn"  # nothing refers to a track
    assert done.checks["recording.artist_credit refers to rows of artist_credit"] == "warn"
    assert done.checks["recording.id holds each id once"] == "ok"
