from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from brute import prose

from catalens.llm import decontamination as dec
from catalens.llm import queries

ITEMS = "item_id long, text string"


def grams(words):
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def similarity(a, b):
    a, b = Counter(a), Counter(b)
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items):
    out = {}
    sizes = {}
    for _, item in items:
        own = (item or "").lower().split()
        sizes.setdefault(len(own), set()).update(grams(own))
    for doc_id, text in docs:
        words = (text or "").lower().split()
        for item_id, item in items:
            own = (item or "").lower().split()
            if not own or not words:
                continue
            size = min(len(own), len(words))
            last, shared = len(words) - size, sizes[len(own)]
            starts = {min(s, last) for s, g in enumerate(grams(words)) if g in shared}
            windows = [(similarity(grams(words[s : s + size]), grams(own)), -s) for s in range(last + 1)]
            # The first of the best windows that start at a shingle of the benchmark's items of this size.
            top = max(windows)[0]
            if top >= 0.8:
                assert any(sim == top and -s in starts for sim, s in windows)
                windows = [(sim, s) for sim, s in windows if -s in starts]
            best = max(windows)
            if best[0] >= 0.8:
                out[doc_id, item_id] = max(out.get((doc_id, item_id), (0, 0, 0)), (*best, size))
    return {k: (pytest.approx(v[0]), -v[1], v[2]) for k, v in out.items()}


def corpus(rng):
    items = [(i, prose(rng, rng.randrange(6, 60))) for i in range(25)]
    items += [(30, "Short One"), (31, ""), (32, None), (33, "a a a a a a a a a a"), (34, items[0][1]), (None, prose(rng, 30))]
    docs = [(i, prose(rng, rng.randrange(0, 150))) for i in range(40)]
    for i in range(40, 160):
        words = rng.choice(items[:25])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.choice([0, 1, len(words) - 1, rng.randrange(len(words))])
            words[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], ["new", "words"]])
        text = " ".join([prose(rng, rng.randrange(30)), *words, prose(rng, rng.randrange(30))])
        docs.append((i, text.upper() if i % 7 == 0 else text.replace(" ", "\n ", 3)))
    docs += [(200, None), (201, ""), (202, "short\tone"), (203, "a " * 40), (204, items[3][1] * 2 + " x " * 5000 + items[4][1])]
    docs += [(300 + i, docs[50][1]) for i in range(20)] + [docs[51], docs[51], (None, items[5][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, documents, table_dir, seed):
    docs, items = corpus(random.Random(seed))
    bench = spark.createDataFrame(items, ITEMS).selectExpr("*", "'x' as fp", "1 as n_words", "'y' as grams")
    folder = table_dir(documents=documents(docs), benchmark=bench)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in queries.op4_decontamination(spark, folder).collect()}
    assert got == brute(docs, items)
    assert len(got) > 30


def test_clean_documents_stay(spark, documents):
    docs, items = corpus(random.Random(3))
    frame = documents(docs)
    kept = dec.clean(frame, spark.createDataFrame(items, ITEMS))
    assert kept.columns == frame.columns
    bad = {d for d, _ in brute(docs, items)}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_blocks_reach_every_fingerprint_within_the_radius():
    rng = random.Random(4)
    most = dec.RADIUS // len(dec.BLOCKS)
    assert sum(w for _, w in dec.BLOCKS) == 64
    for _ in range(3000):
        mask = sum(1 << b for b in rng.sample(range(64), dec.RADIUS))
        assert any((mask >> at & ((1 << w) - 1)).bit_count() <= most for at, w in dec.BLOCKS)
    assert len(dec.flips(8, 2)) == len({f for f in dec.flips(8, 2)}) == 1 + 8 + len(list(combinations(range(8), 2)))


def test_empty_tables(spark, documents):
    docs, items = documents([(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert dec.contaminated(docs.limit(0), items).collect() == []
    assert dec.contaminated(docs, items.limit(0)).collect() == []
    assert dec.clean(docs, items.limit(0)).count() == 1


def test_no_python_in_the_plan(spark, documents):
    docs, items = documents([(1, "a b c d e f")]), spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    plan = dec.contaminated(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_short_items_within_longer_texts(spark, documents, table_dir):
    items = [(1, "Uno due tre"), (2, "single"), (3, "a b c d"), (4, "nowhere to find")]
    rows = [(1, "x y uno  due TRE z w v u t"), (2, "this has a single word in it"), (3, "a b c d"), (4, "0 a b c d"), (5, "uno tre due and b c d a")]
    folder = table_dir(documents=documents(rows), benchmark=spark.createDataFrame(items, ITEMS))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word, r.n_words) for r in queries.op4_decontamination(spark, folder).collect()}
    assert got == {(1, 1): (1.0, 2, 3), (2, 2): (1.0, 3, 1), (3, 3): (1.0, 0, 4), (4, 3): (1.0, 1, 4)}
