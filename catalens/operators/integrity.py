"""Keys by value: ids that repeat, and references to ids that are not there.

Every key column becomes a bitmap (see ``bitmaps``) with a count of its rows, in one scan of
each table and one shuffle of words.  A word of a referring column is then set against the
same word of the column it refers to, so no table is joined with another.  Ids repeat in
words that have more rows than ids; only rows of such words are looked at again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.operators import bitmaps

REPEATED, MISSING, NULL = "repeated id", "missing id", "null id"


@dataclass(frozen=True)
class Reference:
    """``table.column`` holds ids of ``target``, whose key column is ``key``."""

    table: str
    column: str
    target: str
    key: str = "id"

    @property
    def own(self) -> bool:
        """Whether the column is the key that others refer to."""
        return (self.table, self.column) == (self.target, self.key)


def key_words(tables: Mapping[str, DataFrame], references: Sequence[Reference]) -> DataFrame:
    """(source, column, target, own, _word, bits, rows): each column's ids; NULLs have no word."""

    def scanned(table: str) -> DataFrame:
        own = [r for r in references if r.table == table]
        entries = [
            F.struct(
                F.lit(r.column).alias("column"),
                F.lit(r.target).alias("target"),
                F.lit(r.own).alias("own"),
                F.col(r.column).cast("bigint").alias("id"),
            )
            for r in own
        ]
        return tables[table].select(F.lit(table).alias("source"), F.inline(F.array(*entries)))

    rows = reduce(DataFrame.unionByName, [scanned(t) for t in dict.fromkeys(r.table for r in references)])
    keyed = rows.select("source", "column", "target", "own", bitmaps.word_of(F.col("id")).alias(bitmaps.WORD), bitmaps.bit_of(F.col("id")).alias("bits"))
    return keyed.groupBy("source", "column", "target", "own", bitmaps.WORD).agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("rows"))


def _judged(words: DataFrame) -> DataFrame:
    """``words`` with ``lost``: the bits of ids that the target does not have.

    A word of a target meets one row of each column that refers to it.
    """
    same = Window.partitionBy("target", bitmaps.WORD)
    there = F.coalesce(F.max(F.when(F.col("own"), F.col("bits"))).over(same), F.lit(0).cast("bigint"))
    return words.withColumn("lost", F.col("bits").bitwiseAND(F.bitwise_not(there)))


def key_report(words: DataFrame) -> DataFrame:
    """A row per key column: its rows, NULLs, distinct ids, rows that repeat an id (of columns
    that are keys), and distinct ids that its target lacks."""
    names = ["source", "column", "target", "own"]
    zero = F.lit(0).cast("bigint")
    blank = F.col(bitmaps.WORD).isNull()
    sums = _judged(words).groupBy(*names).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(blank, F.col("rows")).otherwise(zero)).alias("nulls"),
        bitmaps.size(F.col("bits")).alias("ids"),
        bitmaps.size(F.col("lost")).alias("lost"),
    )
    return sums.select(
        F.col("source").alias("table_name"),
        F.col("column").alias("column_name"),
        F.col("target").alias("refers_to"),
        F.col("rows").alias("row_count"),
        F.col("nulls").alias("null_rows"),
        F.col("ids").alias("distinct_ids"),
        F.when(F.col("own"), F.col("rows") - F.col("nulls") - F.col("ids")).otherwise(zero).alias("repeated_rows"),
        F.col("lost").alias("missing_ids"),
    )


def violations(tables: Mapping[str, DataFrame], references: Sequence[Reference], words: DataFrame) -> DataFrame:
    """(table_name, column_name, problem, id, rows): every id that repeats in a key column, every
    id referred to that is missing (``rows`` is NULL), and the NULLs of key columns."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("lost"), i).bitwiseAND(F.lit(1)) == 1)
    lost = _judged(words).where("lost <> 0").withColumn("place", F.explode(places))
    missing = lost.select(
        F.col("source").alias("table_name"),
        F.col("column").alias("column_name"),
        F.lit(MISSING).alias("problem"),
        (F.shiftleft(F.col(bitmaps.WORD), 6) + F.col("place")).alias("id"),
        F.lit(None).cast("bigint").alias("rows"),
    )
    blank = words.where(F.col("own") & F.col(bitmaps.WORD).isNull()).select(
        F.col("source").alias("table_name"), F.col("column").alias("column_name"), F.lit(NULL).alias("problem"), F.lit(None).cast("bigint").alias("id"), "rows"
    )
    crowded = words.where(F.col("own") & (F.col("rows") > F.bit_count("bits"))).select("source", bitmaps.WORD)

    def repeated(r: Reference) -> DataFrame:
        rows = tables[r.table].select(F.col(r.column).cast("bigint").alias("id"))
        few = crowded.where(F.col("source") == r.table).select(bitmaps.WORD)
        counts = rows.join(few, bitmaps.word_of(F.col("id")) == F.col(bitmaps.WORD), "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
        return counts.where("rows > 1").select(
            F.lit(r.table).alias("table_name"), F.lit(r.column).alias("column_name"), F.lit(REPEATED).alias("problem"), "id", "rows"
        )

    return reduce(DataFrame.unionByName, [missing, blank, *[repeated(r) for r in references if r.own]])
