"""Figures kept load by load against figures over everything at once."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random

import pytest
from oracle_tools import rows_of

from catalens.functions.sampling import random_sample
from catalens.plans import incremental, kpis
from catalens.plans.incremental import PublishedState
from catalens.sources.contract import CONTRACT

NOW = dt.datetime(2024, 5, 1)
FIGURES = ("stats_overview", "kpi_isrc_coverage", "kpi_iswc_coverage", "party_missing_ids_artist_distinct")


def random_rows(rng, n=60):
    ids = lambda: rng.choice([*range(25), 70, 10**9])
    code = lambda: rng.choice([None, "A", "B", "C", f"x{rng.randrange(9)}"])
    entity = lambda i, **more: {"id": i, "gid": rng.choice([None, "g"]), "edits_pending": rng.choice([0, 0, 1]), **more}
    unique = lambda **make: [entity(i, **{k: f() for k, f in make.items()}) for i in rng.sample([*range(25), 70, 10**9], 20)]
    url = lambda: rng.choice([None, "https://viaf.org/1", "http://wikidata.org/q?imdb", "x"])
    return {
        "artist": unique(type=lambda: rng.choice([1, 1, 2, None])),
        "work": unique(),
        "recording": unique(),
        "release": unique(),
        "isrc": [{"recording": rng.choice([None, ids()]), "isrc": code()} for _ in range(n)],
        "iswc": [{"work": ids(), "iswc": code()} for _ in range(n)],
        "artist_ipi": [{"artist": ids()} for _ in range(10)],
        "artist_isni": [{"artist": ids()} for _ in range(10)],
        "url": [{"id": i, "url": url()} for i in range(15)],
        "l_artist_url": [{"entity0": ids(), "entity1": rng.choice([None, *range(18)])} for _ in range(40)],
    }


def full(cat):
    return {name: rows_of(kpis.KPIS[name].build(cat, as_of=NOW)) for name in FIGURES}


def kept(state):
    own = {name: rows_of(getattr(state, name)(NOW) if name != "stats_overview" else state.stats_overview()) for name in FIGURES}
    return own


@pytest.mark.parametrize("seed", [1, 2])
def test_loads_in_any_split(spark, make_catalogue, tmp_path, seed):
    """Every row goes to a load by chance, some to several; links may come before their ends."""
    rng = random.Random(seed)
    rows = random_rows(rng)
    state = PublishedState(spark, str(tmp_path / "state"))
    parts = [{t: [] for t in rows} for _ in range(3)]
    for table, some in rows.items():
        for row in some:
            for i in {rng.randrange(3), rng.randrange(3)} if table not in ("isrc", "iswc") else {rng.randrange(3)}:
                parts[i][table].append(row)
    for i, part in enumerate(parts):
        assert state.add(f"l{i}", make_catalogue(**part))
        if i == 1:
            state.compact()
    everything = full(make_catalogue(**rows))
    assert kept(state) == everything and state.loads() == ["l0", "l1", "l2"]
    state.compact()
    assert kept(state) == everything and state.loads() == ["l0", "l1", "l2"]


def test_only_the_new_load_is_read(spark, make_catalogue, tmp_path):
    """The first load's files are gone when the second is added and the figures are read."""
    rng = random.Random(5)
    rows = random_rows(rng)
    halves = [{t: some[i::2] for t, some in rows.items()} for i in range(2)]
    state = PublishedState(spark, str(tmp_path / "state"))
    everything = full(make_catalogue(**rows))
    for i, half in enumerate(halves):
        stored = {}
        for name, df in make_catalogue(**half).items():
            path = str(tmp_path / f"load{i}" / name)
            df.write.parquet(path)
            stored[name] = spark.read.schema(CONTRACT[name]).parquet(path)
        state.add(f"load{i}", stored)
        os.rename(tmp_path / f"load{i}", tmp_path / f"gone{i}")
    assert kept(state) == everything


def test_a_load_added_twice_is_there_once(spark, make_catalogue, tmp_path):
    rows = random_rows(random.Random(6))
    cat, state = make_catalogue(**rows), PublishedState(spark, str(tmp_path / "state"))
    assert state.add("a", cat) and not state.add("a", cat)
    # The same rows under another name change nothing but the list of loads.
    before = kept(state)
    assert state.add("b", cat) and kept(state) == before == full(cat)


def test_a_load_that_dies_does_not_count(spark, make_catalogue, tmp_path, monkeypatch):
    rows = random_rows(random.Random(7))
    cat, state = make_catalogue(**rows), PublishedState(spark, str(tmp_path / "state"))

    def die(*_):
        raise RuntimeError("died")

    broken = PublishedState(spark, state.path)
    monkeypatch.setattr(broken._files, "create", die)
    with pytest.raises(RuntimeError):
        broken.add("a", cat)
    assert state.loads() == []
    assert state.add("a", cat) and kept(state) == full(cat)


def test_samples_come_from_sketches(spark, make_catalogue, tmp_path, monkeypatch):
    """The rows that a scan of everything would choose, though each load keeps six."""
    monkeypatch.setattr(incremental, "SAMPLE_ROWS", 6)
    rows = [{"id": i, "name": f"n{i}", "type": i % 3} for i in range(200)]
    state = PublishedState(spark, str(tmp_path / "state"))
    for i in range(4):
        state.add(f"l{i}", make_catalogue(artist=rows[i::4] + rows[:3]))
        if i == 2:
            state.compact()
    whole = random_sample(make_catalogue(artist=rows)["artist"], 6, id_cols=["id"])
    assert sorted(state.sample("artist", 6).collect()) == sorted(whole.collect())
    # What is read: two states of six rows each.
    read = [f for e in state._entries().values() for f in glob.glob(f"{state.path}/{e['folder']}/samples/artist/*.parquet")]
    assert sum(spark.read.parquet(f).count() for f in read) == 12
    counts = {r.table_name: r.row_count for r in state.table_row_counts().collect()}
    assert counts["artist"] == 200 + 4 * 3 and counts["work"] == 0 and len(counts) == len(CONTRACT)
    checks = {r.check: (r.status, r.value) for r in state.load_checks(5).collect()}
    assert checks["recordings loaded"] == ("fail", 0.0) and checks["some work has an ISWC"] == ("fail", 0.0)
    assert state.sample("work", 5).collect() == []
    for table, n in (("isrc", 5), ("artist", 7)):
        with pytest.raises(ValueError, match="samples are kept"):
            state.sample(table, n)


def test_no_loads_and_views(spark, make_catalogue, tmp_path):
    state = PublishedState(spark, str(tmp_path / "state"))
    assert kept(state) == full(make_catalogue()) and state.sample("artist").collect() == []
    state.add("a", make_catalogue(recording=[{"id": 1}], isrc=[{"recording": 1, "isrc": "A"}]))
    assert state.register(NOW) == list(FIGURES)
    assert spark.table("kpi_isrc_coverage").first().unique_isrcs == 1
