"""Fetching the descriptive columns of a few chosen rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, n: int) -> DataFrame:
    """A frame of at most ``n`` rows with the limit stated.

    No row is lost; the limit gives Spark the size, n times the row width, by which its own
    threshold chooses between a broadcast and a shuffled join.
    """
    return df.limit(n)


def attach(sample: DataFrame, n: int, table: DataFrame, on: str) -> DataFrame:
    """Inner join of a sample of at most ``n`` rows with the big table that describes it.

    The sample travels to the table, so the table is scanned but never shuffled.
    """
    return table.join(bounded(sample, n), on)


def attach_optional(sample: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Left join of a sample with a narrow table in which ``on`` is unique.

    Shuffles the table's few columns; picking its rows out first would plan the sample,
    and all that went into it, a second time.
    """
    return sample.join(table, on, "left")


def with_linked_names(
    sample: DataFrame, links: DataFrame, on: str, other: str, named: DataFrame
) -> DataFrame:
    """``sample`` with ``names``: the names of everything linked to its ``on``, as sorted
    [(name, times)], or NULL when there are none.

    ``named`` holds (``other``, name).  The links join onto the sample itself, which is
    therefore planned once.  Equal names are counted before they are collected, so an
    entity linked to the same name again and again stays one entry.
    """
    keys = sample.columns
    linked = sample.join(links.select(on, other), on, "left").join(named, other, "left")
    per_name = linked.groupBy(*keys, "name").count()
    entry = F.when(F.col("name").isNotNull(), F.struct("name", "count"))
    collected = per_name.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("names"))
    return collected.withColumn("names", F.when(F.size("names") > 0, F.col("names")))


def repeat_names(names: str, times: Sequence[str]) -> F.Column:
    """The counted names written out, each ``times`` over; NULL when there are none."""
    def spell(entry: F.Column) -> F.Column:
        copies = entry["count"]
        for column in times:
            copies = copies * F.col(column)
        return F.array_repeat(entry["name"], copies.cast("int"))

    return F.flatten(F.transform(names, spell))
