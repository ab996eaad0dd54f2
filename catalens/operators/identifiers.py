"""Which external identifiers the entities of a population carry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.numeric import pct

_WIDE = "decimal(38,0)"


def join_rows(fanout: Mapping[str, int]) -> str:
    """SQL text: the rows an entity becomes when its link tables are outer-joined.

    ``fanout`` maps a link count to the number of times that table is joined.  The
    product of the counts gives the figure without ever producing those rows; it is a
    decimal because a cube of a large count does not fit a bigint.
    """
    factors = [
        f"cast(greatest({count}, 1) as {_WIDE})"
        for count, times in fanout.items()
        for _ in range(times)
    ]
    return " * ".join(factors)


def presence_profile(
    entities: DataFrame,
    names: Sequence[str],
    label: str,
    fanout: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row of presence figures; ``entities`` has a 0/1 column per identifier.

    The total is the number of entities, or with ``fanout`` the number of join rows
    (see ``join_rows``); those are decimals without places, as they outgrow a bigint.
    """
    total = "count(*)" if fanout is None else f"coalesce(sum({join_rows(fanout)}), 0)"
    sums = entities.selectExpr(
        f"{total} as total", *[f"count_if({name} = 1) as {name}" for name in names]
    )
    return presence_row(sums, names, label)


def presence_row(sums: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """The row of a presence KPI from its counts: total, and one per identifier."""
    held = " + ".join(names)
    return sums.select(
        F.col("total").alias(f"total_{label}"),
        *[F.col(name).alias(f"{label}_with_{name}") for name in names],
        *[
            F.expr(f"total - {name}").alias(f"{label}_missing_{name}")
            for name in names
        ],
        *[pct(name, "total").alias(f"{name}_coverage_pct") for name in names],
        pct(f"({held})", f"(total * {len(names)})").alias("overall_id_completeness_pct"),
    )


def presence_labels(titles: Mapping[str, str]) -> list[Column]:
    """`Has X` / `Missing X` per identifier, as <name>_status."""
    return [
        F.expr(f"case when {name} = 1 then 'Has {title}' else 'Missing {title}' end").alias(
            f"{name}_status"
        )
        for name, title in titles.items()
    ]


def presence_score(names: Sequence[str]) -> Column:
    return F.expr(" + ".join(names))
