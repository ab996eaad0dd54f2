"""Row totals and identifier presence per entity table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.numeric import pct


def overview(entities: Mapping[str, tuple[DataFrame, Column | None]], id_col: str) -> DataFrame:
    """One row per label: how many rows, and how many of them carry ``id_col``."""

    def totals(label: str, df: DataFrame, condition: Column | None) -> DataFrame:
        rows = df if condition is None else df.filter(condition)
        counts = rows.agg(
            F.count(F.lit(1)).alias("total_count"), F.count(id_col).alias(f"with_{id_col}")
        )
        return overview_row(counts, label, id_col)

    return reduce(
        DataFrame.unionByName, [totals(label, df, cond) for label, (df, cond) in entities.items()]
    )


def overview_row(counts: DataFrame, label: str, id_col: str) -> DataFrame:
    """A row of the overview from its counts."""
    return counts.select(
        F.lit(label).alias("entity_type"),
        "total_count",
        f"with_{id_col}",
        pct(f"with_{id_col}", "total_count").alias(f"{id_col}_coverage_pct"),
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: table_name, row_count."""
    return reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count"
            )
            for name, df in tables.items()
        ],
    )
