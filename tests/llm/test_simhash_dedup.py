from __future__ import annotations

import random

import brute
from brute import prose

from catalens.llm import queries, simhash_dedup


def corpus(rng):
    base = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(0, 40))) for i in range(40)]
    for i in range(40, 80):
        words = base.split()
        words[rng.randrange(60)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "One Two"), (84, "one  two\n"), (85, "Ünï\xa0x y z"), (86, base * 300)]
    rows += [(200 - i, base) for i in range(10)] + rows[:3]
    return rows


def expected(rows):
    prints = [brute.simhash(t) for _, t in rows]
    distinct = sorted(set(prints))
    label = brute.components(distinct, lambda a, b: (a ^ b).bit_count() <= 2)
    group = dict(zip(distinct, label))
    lowest = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            lowest[group[p]] = min(lowest.get(group[p], i), i)
    return sorted(((i, f"{p:016x}", lowest.get(group[p])) for (i, _), p in zip(rows, prints)), key=repr)


def test_fingerprints_and_groups_match_brute_force(spark, documents, table_dir):
    rows = corpus(random.Random(5)) + [(None, "only here and nowhere else")]
    folder = table_dir(documents=documents(rows))
    got = sorted((tuple(r) for r in queries.op6_simhash_groups(spark, folder).collect()), key=repr)
    assert got == expected(rows)


def test_chains_over_bits_are_one_component(spark):
    """Fingerprints two bits apart from the next only, and a lone one."""
    chain = [0]
    for i in range(30):
        chain.append(chain[-1] ^ (3 << 2 * i))
    signed = [c - (1 << 64) if c >> 63 else c for c in [*chain, 0b1111 << 60]]
    rows = [(i, p) for i, p in enumerate(signed)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long").selectExpr("doc_id", "'' as text_key", "fp")
    got = {r.doc_id: r.component_id for r in simhash_dedup.components(prints).collect()}
    assert all(got[i] == 0 for i in range(31))
    assert got[31] == (0 if min((c ^ (0b1111 << 60)).bit_count() for c in chain) <= 2 else 31)


def test_all_pairs_within_the_radius_are_linked(spark):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(30)}
    for v in list(values):
        values |= {v ^ (1 << rng.randrange(64)), v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    values = sorted(values)
    rows = [(i, simhash_dedup._signed(v)) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "doc_id long, fp long").selectExpr("doc_id", "'' as text_key", "fp")
    got = {r.doc_id: r.component_id for r in simhash_dedup.components(prints).collect()}
    label = brute.components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    assert [got[i] for i in range(len(values))] == label


def test_keep_one_of_each_group(spark, documents):
    rows = corpus(random.Random(9)) + [(None, "one two")]
    docs = documents(rows)
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    assert got == sorted({c for _, _, c in expected(rows)})


def test_empty_table(spark, documents):
    docs = documents([(1, "a")]).limit(0)
    assert simhash_dedup.near_duplicates(docs).collect() == []
    assert simhash_dedup.keep_one(docs).collect() == []
