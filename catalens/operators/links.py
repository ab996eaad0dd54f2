"""Audits of link tables: who is linked, who is not, and how often."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.functions.numeric import pct
from catalens.operators.evidence import Evidence, observe


def link_state(
    entity: DataFrame,
    link: DataFrame,
    link_key: str,
    link_value: str,
    path: DataFrame | None = None,
    path_key: str | None = None,
) -> DataFrame:
    """Per entity of the population: linked 0/1, links, and with ``path`` also paths.

    ``links`` counts the link rows that name something, ``link_rows`` all of them;
    ``path`` is a table whose rows lead to the entity, and entities it never reaches
    are left out.
    """
    counts = {"links": f"{link_value} is not null", "link_rows": "1"}
    evidence = [Evidence(link, link_key, {"linked": None}, counts=counts)]
    if path is None:
        return observe(entity, evidence)
    evidence.append(Evidence(path, path_key, {"reached": None}, counts={"paths": "1"}))
    return observe(entity, evidence).where("reached = 1")


def link_audit(
    state: DataFrame, label: str, linked_to: str, distinct_entities: bool = True
) -> DataFrame:
    """One row: total, how many linked, how many not, and both as percentages.

    With ``distinct_entities=False`` the total counts the rows of an outer join with the
    link table, so an entity with five links counts five times.
    """
    join_rows = "coalesce(sum(greatest(link_rows, 1)), 0)"
    sums = state.selectExpr(
        f"{'count(*)' if distinct_entities else join_rows} as total",
        "count_if(linked = 1) as linked",
        "count_if(linked = 0) as unlinked",
    )
    return sums.select(
        F.col("total").alias(f"total_{label}"),
        F.col("linked").alias(f"{linked_to}_with"),
        F.col("unlinked").alias(f"{linked_to}_without"),
        pct("linked", "total").alias("with_pct"),
        pct("unlinked", "total").alias("without_pct"),
    )


def unlinked_count(state: DataFrame, weight: str = "1") -> DataFrame:
    """One row, ``n``: the entities without a link, or the sum of ``weight`` over them."""
    return state.selectExpr(f"coalesce(sum(case when linked = 0 then {weight} end), 0) as n")


def inconsistency_shares(counts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per label with its count and its share of all counts."""
    columns = [f"n{i}" for i in range(len(counts))]
    parts = [
        frame.selectExpr(*[f"cast({'n' if c == own else 0} as bigint) as {c}" for c in columns])
        for own, frame in zip(columns, counts.values())
    ]
    wide = reduce(DataFrame.unionByName, parts).groupBy().sum().toDF(*columns)
    rows = ", ".join(
        f"named_struct('inconsistency_type', '{label}', 'count', {c}, "
        f"'total', {' + '.join(columns)})"
        for label, c in zip(counts, columns)
    )
    return wide.selectExpr(f"inline(array({rows}))").select(
        "inconsistency_type",
        "count",
        pct("count", "total").alias("percentage_of_inconsistencies"),
    )
