"""Fingerprints and their order against a plain version."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
import xxhash
from brute import WHITE, prose

from catalens.llm import document_fingerprints as dp
from catalens.llm import queries


def hashes(text):
    words = [xxhash.xxh64_digest(w.encode(), 42)[::-1] for w in WHITE.findall(text)]
    out = set()
    for i in range(max(1, len(words) - 4) if words else 0):
        seed = 42
        for w in words[i : i + 5]:
            seed = xxhash.xxh64_intdigest(w, seed)
        out.add(struct.unpack("<q", struct.pack("<Q", seed))[0])
    return out


def codes(text):
    best = {}
    for h in hashes(text):
        place, value = (h >> 56) + 128, h & (1 << 56) - 1
        best[place] = min(best.get(place, value), value)
    if not best:
        return []
    starts, strides, _ = dp._cycles()
    out = []
    for i in range(256):
        at, t = i, 0
        while at not in best:
            at = (starts[i] + t * strides[i]) % 256
            t += 1
        out.append(best[at] & 15)
    return out


def like(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (15 / 16))


def brute(rows):
    key = lambda t: struct.unpack("<q", xxhash.xxh64_digest(t.encode(), 42)[::-1])[0]
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, key(r[1])), reverse=True)
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        third = len(text) // 3
        new = text[: len(text) - third] + after[:third]
        own, other = codes(text), codes(new)
        digits = ["".join(f"{c:x}" for c in x) for x in (own, other)]
        out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), *digits, like(own, other), like(own, codes(after))))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def found(spark, folder):
    return sorted((tuple(r[c] for c in COLUMNS) for r in queries.op12_document_fingerprints(spark, folder).collect()), key=repr)


def test_whole_query(spark, documents, table_dir):
    rng = random.Random(9)
    rows = [(rng.randrange(1000) * 3, prose(rng, rng.choice([1, 3, 5, 6, 20, 60, 400]))) for _ in range(90)]
    rows += [(5000 + i, rows[0][1]) for i in range(40)]  # copies
    # Ties, repeated rows, nulls, empty and white texts, null ids, odd letters, a very long text.
    rows += [(7, "a b"), (7, "a c"), (7, "a c"), (8, None), (9, ""), (10, " \t\n"), (None, "null id"), (None, "null id"), (None, None)]
    rows += [(11, "é語😀 " * 40), (12, prose(rng, 40_000, 30_000)), (13, "x" * 50_000), (14, "\x1c \x85 a")]
    assert found(spark, table_dir(documents=documents(rows).repartition(6))) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "only one")], [(1, None)], [(1, "a b c d e f"), (2, "")], [(None, "x"), (None, "x")]])
def test_few_rows(spark, documents, table_dir, rows):
    assert found(spark, table_dir(documents=documents(rows))) == brute(rows)


def test_estimates_are_unbiased(spark):
    """Likeness of sets of known similarity: the mean error is small, and none is large."""
    rng = random.Random(10)
    errors = []
    pairs = []
    for _ in range(150):
        text = prose(rng, 500, 50_000).split()
        cut = rng.randrange(20, 480)
        other = text[:cut] + prose(rng, 500 - cut, 50_000).split()
        pairs.append((" ".join(text), " ".join(other)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", dp.likeness(dp.fingerprint(df.a), dp.fingerprint(df.b)).alias("x")).collect()
    for r in got:
        one, two = hashes(r.a), hashes(r.b)
        errors.append(r.x - len(one & two) / len(one | two))
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.15


def test_ranges_are_dealt_one_to_a_partition(spark):
    from pyspark.sql import functions as F

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = dp.even_labels(spark, parts)
    rows = spark.createDataFrame([(n,) for n in labels], "n int").select(F.pmod(F.hash("n"), F.lit(parts)).alias("p"))
    assert sorted(r.p for r in rows.collect()) == list(range(parts))
    assert len(set(dp.even_labels(spark, 3 * parts))) == 3 * parts


def test_plan(spark, documents, table_dir):
    """No Python; the bounds are worked out once; a text is shuffled in one column."""
    docs = spark.read.parquet(table_dir(documents=documents([(i, f"t {i}") for i in range(50)])) + "/documents.parquet")
    df = dp.compared(docs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "from_json" not in plan.lower()
    assert plan.count("Exchange hashpartitioning(range") == 2 and "_w0" not in plan and "SortMergeJoin" not in plan
