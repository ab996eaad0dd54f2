from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from brute import prose

from catalens.llm import queries, topk_search as ts


def bm25(docs, asked, k):
    """Every document scored for every query: (query id, rank, doc id, score)."""
    counts = [ts.terms_of(t) for _, t in docs]
    mean = sum(c.total() for c in counts) / len(docs)
    df = Counter(t for c in counts for t in c)
    out = []
    for qid, text in asked:
        scored = []
        for (i, _), c in zip(docs, counts):
            norm = ts.K1 * (1 - ts.B + ts.B * c.total() / mean)
            score = sum(
                n * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (ts.K1 + 1) / (c[t] + norm)
                for t, n in ts.terms_of(text).items()
                if c[t]
            )
            if score > 0:
                scored.append((-round(score, 7), i is None, i))
        scored.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(qid, rank, i, pytest.approx(-s, abs=1e-6)) for rank, (s, _, i) in enumerate(scored[:k], 1)]
    return out


def corpus(rng, n=700):
    rows = [(i, prose(rng, rng.randrange(1, 120), rng.choice([30, 400, 4000]))) for i in range(n)]
    rows += [(n + i, rows[50][1]) for i in range(25)]
    return rows + [(5000, None), (5050, ""), (5100, "!!! ..."), (5001, "w1 " * 30_000), (None, rows[100][1]), (5200, "Unique WORDS here_there")]


@pytest.mark.parametrize(("block", "common", "shard"), [(128, 0.1, 1 << 14), (8, 0.02, 100)])
def test_matches_scoring_everything(spark, documents, table_dir, monkeypatch, block, common, shard):
    rows = corpus(random.Random(3))
    folder = table_dir(documents=documents(rows).repartition(3))
    got = queries.op10_topk_search(spark, folder).collect()
    asked = [(i, t) for i, t in rows if i is not None and i % 50 == 0]
    assert sorted(tuple(r) for r in got) == sorted(bm25(rows, asked, 10), key=lambda r: r[:2])


def test_queries_without_an_id(spark, documents):
    rows = [(i, prose(random.Random(i), 20, 50)) for i in range(60)]
    asked = [(None, "w1 w2 w3"), (None, "w4 w5"), (None, "w1 w2 w3"), (7, "w1 w2 w3"), (None, None)]
    got = ts.search(documents(rows), documents(asked), 5).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append((r.rank, r.doc_id))
    expected = {i: [(rank, d) for q, rank, d, _ in bm25(rows, [(i, t)], 5)] for i, t in [("a", "w1 w2 w3"), ("b", "w4 w5")]}
    assert by_query[7] == expected["a"] and sorted(by_query[None]) == sorted(expected["a"] + expected["b"])


@pytest.mark.parametrize(("block", "common", "docs"), [(4, 0.02, 64), (16, 0.3, 200), (128, 2.0, 50)])
def test_pruned_shards_match_scoring_everything(monkeypatch, block, common, docs):
    monkeypatch.setattr(ts, "BLOCK_DOCS", block)
    monkeypatch.setattr(ts, "COMMON", common)
    rows = corpus(random.Random(4), 300)
    asked = rows[:330:10]
    mean = sum(ts.terms_of(t).total() for _, t in rows) / len(rows)
    df = Counter(t for _, text in rows for t in ts.terms_of(text))
    vectors = []
    for _, text in asked:
        pairs = sorted((ts.term_hash(t), n * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))) for t, n in ts.terms_of(text).items())
        vectors.append((np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])))
    best = ts.Best(len(asked), 5)
    for at in range(0, len(rows), docs):
        ids, texts = zip(*rows[at : at + docs])
        ts.Shard(ts.build_shard(list(ids), list(texts)), mean).search(vectors, best)
    got, seen = [], Counter()
    for q, score, i in zip(best.query, best.score, best.id):
        seen[q] += 1
        got.append((asked[q][0], seen[q], None if i == ts.NO_ID else i, score))
    assert got == bm25(rows, asked, 5)


def test_blocks_below_the_threshold_are_not_looked_into(monkeypatch):
    monkeypatch.setattr(ts, "BLOCK_DOCS", 8)
    rng = random.Random(5)
    texts = [prose(rng, 60, 40) for _ in range(200)] + [f"b{t} " + prose(rng, 60, 40).replace("w", "v") for t in range(200)]
    shard = ts.Shard(ts.build_shard(list(range(400)), texts), 60.0)
    looked = []
    score = ts.Best.add
    monkeypatch.setattr(ts.Best, "add", lambda self, *a: (looked.append(1), score(self, *a)))
    terms = sorted(ts.term_hash(t) for t in ts.terms_of(texts[7]))
    shard.search([(np.array(terms, np.uint64), np.ones(len(terms)))], ts.Best(1, 3))
    assert 0 < len(looked) <= shard.blocks // 2


def test_empty_tables(spark, documents):
    docs = documents([(1, "a b"), (2, None)])
    assert ts.search(docs.limit(0), docs).collect() == []
    assert ts.search(docs, docs.limit(0)).collect() == []
    assert ts.search(docs, documents([(50, None), (100, "zzz")])).collect() == []


def two_languages(rng, n=300):
    """Texts of two vocabularies in turns, numerals that both have, and repeats."""
    texts = [prose(rng, rng.randrange(20, 90), 300).replace("w", "wv"[i % 3 == 0]) + f" {rng.randrange(40)}" for i in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n + i, texts[9 * i]) for i in range(20)] + [(None, texts[3]), (900, None)]


def vectors_of(rows, asked):
    df = Counter(t for _, text in rows for t in ts.terms_of(text))
    pairs = [sorted((ts.term_hash(t), n * math.log(1 + (len(rows) - df[t] + 0.5) / (df[t] + 0.5))) for t, n in ts.terms_of(text).items()) for _, text in asked]
    return [(np.array([p[0] for p in own], np.uint64), np.array([p[1] for p in own])) for own in pairs]


@pytest.mark.parametrize(("dense", "cost", "chunk", "entries"), [(0.04, 800, 256, 1 << 15), (0.0, 10**9, 7, 64), (2.0, 0, 3, 1), (0.02, 300, 50, 500)])
def test_parts_of_alike_documents_match_scoring_everything(monkeypatch, dense, cost, chunk, entries):
    for name, value in {"PART_DOCS": 20, "BLOCK_DOCS": 16, "COMMON": 0.05, "DENSE": dense, "ENTRY_COST": cost, "QUERY_CHUNK": chunk, "ENTRIES": entries}.items():
        monkeypatch.setattr(ts, name, value)
    rows = two_languages(random.Random(6))
    arrays = ts.build_shard(*map(list, zip(*rows)))
    language = {i: (t or "wv")[0] for i, t in rows}
    spans = list(zip(arrays["part_docs"], arrays["part_docs"][1:]))
    assert len(spans) > 1 and all(len({language[i] for i in arrays["ids"][a:b].tolist() if i not in (900, ts.NO_ID)}) == 1 for a, b in spans)
    asked = rows[:300:7]
    best = ts.Best(len(asked), 6)
    ts.Shard(arrays, sum(ts.terms_of(t).total() for _, t in rows) / len(rows)).search(vectors_of(rows, asked), best)
    got, seen = [], Counter()
    for q, score, i in zip(best.query, best.score, best.id):
        seen[q] += 1
        got.append((asked[q][0], seen[q], None if i == ts.NO_ID else i, score))
    assert got == bm25(rows, asked, 6)


def test_scores_do_not_depend_on_the_split(monkeypatch):
    for name, value in {"PART_DOCS": 20, "BLOCK_DOCS": 16, "COMMON": 0.05, "DECIMALS": 15}.items():
        monkeypatch.setattr(ts, name, value)
    rows = two_languages(random.Random(8))
    vectors, found = vectors_of(rows, rows[:300:5]), set()
    for dense, cost, size in [(0.0, 10**9, 1000), (2.0, 0, 1000), (0.1, 500, 90)]:
        monkeypatch.setattr(ts, "DENSE", dense)
        monkeypatch.setattr(ts, "ENTRY_COST", cost)
        best = ts.Best(len(vectors), 8)
        for at in range(0, len(rows), size):
            ts.Shard(ts.build_shard(*map(list, zip(*rows[at : at + size]))), 50.0).search(vectors, best)
        found.add((best.query.tobytes(), best.score.tobytes(), best.id.tobytes()))
    assert len(found) == 1


def test_common_terms_of_many_queries_are_not_added_up_by_lists(monkeypatch):
    monkeypatch.setattr(ts, "PART_DOCS", 20)
    rows = two_languages(random.Random(7))
    vectors = vectors_of(rows, rows[:300])
    walked, lists = [], ts.Part.rare_scores
    monkeypatch.setattr(ts.Part, "rare_scores", lambda self, begins, sizes, *rest: (walked.append(int(sizes.sum())), lists(self, begins, sizes, *rest))[1])
    shard = ts.Shard(ts.build_shard(*map(list, zip(*rows))), 50.0)
    shard.search(vectors, ts.Best(300, 3))
    counts = [set(ts.terms_of(t)) for _, t in rows]
    matches = sum(len(a & b) for a in counts[:300] for b in counts)
    assert 0 < sum(walked) < matches / 4


def test_terms_are_the_same_with_and_without_other_characters():
    for text in ("Ab_c d-1 x²", "K_ß 12a_b", "tab\tnew\nline\x1c\x00z_9", "", "İ_é", "\u212a_x"):
        assert ts.terms_of(text) == Counter(ts.TERM.findall(text.lower()))
