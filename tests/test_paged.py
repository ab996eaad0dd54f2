"""Lists in pages against whole sorted lists."""

from __future__ import annotations

import random

import pytest
from oracle_tools import rows_of

from catalens.operators.paged import name_pages


def whole_lists(pairs):
    out = {}
    for key, name in pairs:
        if name is not None:
            out.setdefault(key, []).append(name)
    return {k: sorted(v, key=lambda s: s.encode()) for k, v in out.items()}


@pytest.mark.parametrize(("page", "ranges"), [(1, 3), (7, 1), (7, 12), (1000, 4)])
def test_pages_are_the_list(spark, page, ranges):
    rng = random.Random(page)
    pairs = [(rng.choice([None, 1, 2, 2, 2, 2, *range(9)]), rng.choice([None, "", "a", "é", "B", *(f"n{i}" for i in range(40))])) for _ in range(500)]
    pairs += [(3, "same")] * 100
    df = spark.createDataFrame(pairs, "k bigint, n string").repartition(5)
    got = {}
    for r in sorted(rows_of(name_pages(df, "k", "n", page, ranges)), key=lambda r: r["page"]):
        own = got.setdefault(r["k"], [])
        assert r["page"] == len(own) // page + 1 and 0 < len(r["names"]) <= page
        own += r["names"]
    assert got == whole_lists(pairs)


def test_an_entity_of_a_million_links(spark):
    """Its names are dealt to several ranges, no page is longer than the others, none is lost."""
    links = spark.range(1_000_000).selectExpr("if(id % 10 = 0, id, 7) as k", "concat('name ', id % 90000) as n")
    pages = name_pages(links, "k", "n", 1000, 8).where("k = 7")
    (row,) = pages.selectExpr("count(*) as pages", "sum(size(names)) as names", "max(size(names)) as longest", "max(page) as last").collect()
    assert (row.names, row.longest, row.pages, row.last) == (900_000, 1000, 900, 900)
    ends = {r.page: (r.names[0], r.names[-1]) for r in pages.collect()}
    assert all(ends[i][1] <= ends[i + 1][0] for i in range(1, 900))


def test_no_names_and_no_page(spark):
    assert name_pages(spark.createDataFrame([(1, None)], "k bigint, n string"), "k", "n").collect() == []
    with pytest.raises(ValueError, match="page"):
        name_pages(spark.createDataFrame([], "k bigint, n string"), "k", "n", 0)
