"""Long ordered lists in pages, for entities that are linked to very many others.

A list as one array has to fit one row, and sorting it has to fit one task.  Here the names
of all entities are dealt out by ranges of (entity, name), so an entity with millions of them
is spread over as many ranges as it fills; places are counted within ranges and shifted by
what earlier ranges hold of the entity, and only a page of names ever becomes an array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.operators.skew import default_parts
from catalens.sources.store import shared_table

PAGE = 1000


def name_pages(
    names: DataFrame,
    key: str,
    name: str,
    page: int = PAGE,
    ranges: int | None = None,
    stored: Callable[[DataFrame, str], DataFrame] = shared_table,
) -> DataFrame:
    """(``key``, page, names): the names of each key in order, repeats included, ``page`` to a
    row; the pages count from 1.  NULL names are no names."""
    if page < 1:
        raise ValueError(f"a page holds one name at least, not {page}")
    ranges = ranges or default_parts(names)
    # Equal names are counted first: however often a name comes, it is one row here.
    counted = names.where(F.col(name).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(name).alias("_name")).agg(F.count(F.lit(1)).alias("_times"))
    dealt = counted.repartitionByRange(ranges, "_key", "_name").withColumn("_range", F.spark_partition_id())
    # Stored, as ranges that are worked out again may have other bounds.
    dealt = stored(dealt, "names-in-ranges")
    held = dealt.groupBy("_key", "_range").agg(F.sum("_times").alias("_held"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.withColumn("_before", F.coalesce(F.sum("_held").over(earlier), F.lit(0))).drop("_held")
    here = Window.partitionBy("_key", "_range").orderBy("_name").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumn("_at", F.coalesce(F.sum("_times").over(here), F.lit(0)))
    placed = within.join(starts, (within["_key"].eqNullSafe(starts["_key"])) & (within["_range"] == starts["_range"])).select(
        within["_key"], "_name", "_times", (F.col("_at") + F.col("_before")).alias("_first")
    )
    last = F.col("_first") + F.col("_times") - 1
    pages = placed.withColumn("_page", F.explode(F.sequence(F.floor(F.col("_first") / page), F.floor(last / page))))
    begin = F.greatest(F.col("_first"), F.col("_page") * page)
    end = F.least(last, (F.col("_page") + 1) * page - 1)
    entry = F.struct(begin.alias("at"), F.col("_name").alias("name"), (end - begin + 1).cast("int").alias("copies"))
    lists = pages.groupBy("_key", "_page").agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    spelled = F.flatten(F.transform("_entries", lambda e: F.array_repeat(e["name"], e["copies"])))
    return lists.select(F.col("_key").alias(key), (F.col("_page") + 1).alias("page"), spelled.alias("names"))
