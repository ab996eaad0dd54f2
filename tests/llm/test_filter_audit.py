"""The audit against running every order over every document."""

from __future__ import annotations

import random
from itertools import permutations

import numpy as np
import pytest
from brute import WHITE, prose
from oracle_tools import assert_same, over_parquet

from catalens.llm import filter_audit, queries

LABELS = "doc_id long, quality int, toxic int"
SF_DIR = "/root/testdata/sf0.001"


def fails(text):
    words = WHITE.findall(text)
    return [
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        any(c in "#$%&*|" for c in text),
    ]


def brute(rows, labels):
    rows = [(d, t or "", lang or "") for d, t, lang in rows]
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    good, toxic = ({d for d, *flags in labels if flags[i] == 1} for i in (0, 1))
    judged = [(p, [*fails(t), d is not None and d > first[t]], d in good and d is not None, d in toxic and d is not None) for d, t, p in rows]
    out, shapley = {}, {}
    for part in {p for p, *_ in judged}:
        own = [j[1:] for j in judged if j[0] == part]
        for order in permutations(range(5)):
            left = own
            for step, f in enumerate(order, 1):
                hit, kept = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                all_fail = sum(d[0][f] for d in own)
                only = sum(d[0][f] and sum(d[0]) == 1 for d in own)
                name = "".join("ABCDE"[i] for i in order)
                out[part, name, step] = [len(kept), len(hit), all_fail - len(hit), only, sum(d[1] for d in hit), sum(d[2] for d in hit)]
                shapley[part, f] = shapley.get((part, f), 0) + len(hit)
                left = kept
    return {k: tuple(v + [shapley[k[0], "ABCDE".index(k[1][k[2] - 1])]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    result = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(result) == len(rows)
    return result


def test_all_orders(spark, documents):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        text = prose(rng, rng.choice([5, 90, 99, 100, 101, 130]), rng.choice([40, 5000]))
        text = text.upper() if rng.random() < 0.3 else text
        text += rng.choice(["", "", " #", " 5%"])
        rows.append((i, text, rng.choice(["en", "fr", None, ""])))
    rows += [(200 + i, rows[7][1], "en") for i in range(30)]
    # Nulls, empty and repeated rows, a null id beside its copy, very long texts, other white space.
    rows += [(300, None, "en"), (301, "", None), (302, "", "de"), (302, "", "de"), (None, rows[0][1], "en"), (None, rows[0][1], "en")]
    rows += [(400, prose(rng, 60_000, 50_000), "en"), (401, " ".join(f"W{i}" for i in range(120)), "en"), (402, "Å" * 50 + "A" * 6, "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 420, 2)]
    labels += [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = documents([(d, t, p) for d, t, p in rows])
    assert found(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(documents([]), none).collect() == []
    result = found(filter_audit.audit(documents([(1, "a", "en")]), none))
    assert len(result) == 600 and result["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 1000, 4097])
def test_positional_popcount(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    expected = [int((words >> np.uint32(b) & 1).sum()) for b in range(32)]
    assert filter_audit.positional_popcount(words).tolist() == expected


def test_survival_words():
    words = filter_audit.survival_words(5)
    assert int(words[0]) == 0xFFFFFFFF and int(words[31]) == 1
    assert all(bool(int(words[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def test_query_matches_sql(spark):
    assert_same(queries.op11_filter_audit(spark, SF_DIR), over_parquet(SF_DIR), queries.ORACLE["op11_filter_audit"])
