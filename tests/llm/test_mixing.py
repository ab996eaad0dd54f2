from __future__ import annotations

import random

import pytest
from brute import prose
from oracle_tools import assert_same, over_parquet

from catalens.llm import mixing, queries


def corpus(rng, n=600):
    rows = []
    for i in range(n):
        source = "a" if i % 3 == 0 else rng.choice(["b", "ä", "Z", None, "empty"])
        text = None if source == "empty" else prose(rng, rng.randrange(1, 60))
        rows.append((i, text, "en", source))
    return rows + rows[:5] + [(None, "x y", "en", "b"), (None, None, None, None), (n, "\x1c \x85 ", "en", "b")]


def test_matches_sql(spark, documents, table_dir):
    folder = table_dir(documents=documents(corpus(random.Random(1))))
    assert_same(queries.op3_source_mix(spark, folder), over_parquet(folder), queries.ORACLE["op3_source_mix"])


def dealt(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        left = share * sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        targets = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = {s: most * sizes[s] for s in open_ if targets[s] > most * sizes[s]}
        if not above:
            return fixed | targets
        fixed |= above


@pytest.mark.parametrize("seed", range(4))
def test_targets_match_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 100000]) + rng.randrange(50) for i in range(9)} | {None: 40}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(table).collect()}
    assert got == pytest.approx(dealt(sizes))


def test_taken_words_come_near_the_targets(spark, documents):
    plan = mixing.plan(documents(corpus(random.Random(2), 6000))).collect()
    for source in {r.source for r in plan}:
        rows = [r for r in plan if r.source == source]
        assert all(r.copies <= 2 for r in rows)
        assert sum(r.size * r.copies for r in rows) == pytest.approx(rows[0].target, rel=0.1, abs=60)


def test_mix_repeats_documents_as_planned(spark, documents):
    docs = documents(corpus(random.Random(3), 200)[:200])
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    planned = {r.doc_id: r.copies for r in mixing.plan(docs).collect() if r.copies}
    assert counts == planned
    assert sorted(mixed.collect()) == sorted(mixing.mix(docs.repartition(7)).collect())


def test_empty_table(spark, documents):
    docs = documents([(1, "a")]).limit(0)
    assert mixing.plan(docs).collect() == [] and mixing.mix(docs).collect() == []
