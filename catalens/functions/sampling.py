"""Reproducible samples: a seeded hash stands in for a random sort key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def seeded_key(seed: int, id_cols: Sequence[str]) -> Column:
    """A pseudo-random but repeatable key for the row that ``id_cols`` identify."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in id_cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def seeded_top_k(
    df: DataFrame,
    order_cols: Sequence[Column],
    id_cols: Sequence[str],
    n: int,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """First ``n`` rows by ``order_cols``, ties broken by the seeded key.

    Spark plans this as a top-k per partition followed by a merge of n-row lists, so
    no full sort runs and the answer does not depend on the partitioning.
    """
    return df.orderBy(
        *order_cols, seeded_key(seed, id_cols), *[F.col(c).asc_nulls_first() for c in id_cols]
    ).limit(n)


def random_sample(
    df: DataFrame,
    n: int = 10,
    seed: int = DEFAULT_SEED,
    id_cols: Sequence[str] | None = None,
) -> DataFrame:
    """``n`` random rows as JSON text in one column, ``sample_data``.

    With ``id_cols`` only those columns are hashed and the JSON is built for the chosen
    rows alone; without, every column takes part in the key.
    """
    chosen = seeded_top_k(df, [], list(id_cols or df.columns), n, seed)
    row = F.struct(*[F.col(c) for c in df.columns])
    return chosen.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("sample_data"))
