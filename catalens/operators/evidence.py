"""Presence flags per entity, gathered from many tables in one shuffle.

"Does X have at least one Y" is asked of every entity many times over.  Instead of one
join per question, each table contributes small rows (key, bit), a single
``groupBy(key)`` ORs the bits together, and the entities take up the result in one join:

* the shuffle carries a key and a bigint, nothing else;
* partial aggregation folds a key that holds any share of the rows into one row per
  task before the shuffle, so hot keys cost nothing;
* both sides of the join have one row per key and are partitioned by it already, so no
  row is ever multiplied and no join task is larger than another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Flags that share one bigint mask; further flags go to further masks.
MASK_BITS = 63


@dataclass(frozen=True)
class Evidence:
    """What one table says about the entities its ``key`` column names.

    ``flags``: flag name -> SQL condition, or None when every row is proof.
    ``counts``: measures to add up per entity, as SQL.
    """

    rows: DataFrame
    key: str
    flags: Mapping[str, str | None] = field(default_factory=dict)
    counts: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def of_flags(cls, rows: DataFrame, key: str, names: Sequence[str]) -> Evidence:
        """Pass on 0/1 columns under their own names."""
        return cls(rows, key, {name: f"{name} = 1" for name in names})


def observe(
    entity: DataFrame,
    evidence: Sequence[Evidence],
    flags: Mapping[str, str] | None = None,
    carry: Sequence[str] = (),
    key: str = "id",
) -> DataFrame:
    """One row per entity: its id as ``key``, every flag as 0/1, every count, ``carry``.

    ``entity`` is the population, unique on ``id``; ``flags`` are SQL conditions over its
    own columns, ``carry`` columns of it to keep.  Evidence about other keys is dropped.
    """
    own = dict(flags or {})
    seen_flags = list(dict.fromkeys(name for e in evidence for name in e.flags))
    counts = list(dict.fromkeys(name for e in evidence for name in e.counts))
    bit = {name: (f"_mask{i // MASK_BITS}", 1 << i % MASK_BITS) for i, name in enumerate(seen_flags)}
    masks = list(dict.fromkeys(mask for mask, _ in bit.values())) or ["_mask0"]

    def contribution(e: Evidence) -> DataFrame:
        def bits(mask: str) -> str:
            own = {name: cond for name, cond in e.flags.items() if bit[name][0] == mask}
            always = sum(bit[name][1] for name, cond in own.items() if cond is None)
            when = [
                f"case when {cond} then {bit[name][1]}L else 0L end"
                for name, cond in own.items()
                if cond is not None
            ]
            return " + ".join([f"{always}L", *when])

        rows = e.rows.selectExpr(
            f"{e.key} as {key}",
            *[f"{bits(mask)} as {mask}" for mask in masks],
            *[f"cast({e.counts.get(c, 0)} as bigint) as {c}" for c in counts],
        )
        silent = not (None in e.flags.values() or e.counts)
        some = " or ".join(f"{mask} <> 0" for mask in masks)
        return rows.where(f"{key} is not null{f' and ({some})' if silent else ''}")

    seen = (
        reduce(DataFrame.union, [contribution(e) for e in evidence])
        .groupBy(key)
        .agg(*[F.bit_or(m).alias(m) for m in masks], *[F.sum(c).alias(c) for c in counts])
    )
    population = entity.selectExpr(
        f"id as {key}",
        *[f"cast(coalesce({cond}, false) as int) as {name}" for name, cond in own.items()],
        *carry,
    )
    return population.join(seen, key, "left").selectExpr(
        key,
        *own,
        *[
            f"cast(coalesce({mask} & {value}L <> 0, false) as int) as {name}"
            for name, (mask, value) in bit.items()
        ],
        *[f"coalesce({c}, 0) as {c}" for c in counts],
        *carry,
    )
