"""Mixing sources to target weights.

Words are counted per document and summed per source.  Each source gets a target, and so
a repetition rate target / size; every document is taken floor(rate) times and once more
with probability equal to the fraction, drawn from a hash of the seed, its id and its text.

The draw needs no ordering and no state, so a source with a third of all rows is spread
over all tasks; only sums per source are shuffled.  The table of sources has one row per
source and is the only thing handled in one task.

Defined cases: a null text has size 0.  A null source is a source of its own, last in
order.  Sources of size 0 get target 0 and are not taken.  Rows with the same id and text
share a draw.  Very long texts are measured whole.  An empty table gives an empty mix.
Other columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.shared import WORD, text_key, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = 42
DRAW_BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the seed, the id and the text."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text_key(text))
    digits = F.substring(F.md5(key), 1, DRAW_BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << DRAW_BITS))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) with each source's target.

    ``share`` of all words is dealt out by weight (repeating, in order of the source's
    code points, null last), no source getting more than ``max_repeat`` times its size.
    That is target = min(cap, level * weight) with one level for all: with sources in
    order of cap / weight, the level that results if all before a row are capped rises
    up to the first row that is not, and falls after it, so the level is its maximum.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size").cast("double") * max_repeat
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything) * share
    capped = F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    level = F.max("_level").over(everything)
    return (
        rows.withColumn("_level", (total - capped) / F.sum("weight").over(onward))
        .withColumn("target", F.least(cap, level * F.col("weight")))
        .select("source", "source_size", "target")
    )


def plan(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """Per document: id, source, size, draw, source_size, target and ``copies``."""
    measured = written(
        docs.select(
            F.col(id_col),
            F.col("source"),
            word_count(F.col("text")).alias("size"),
            draw(F.col(id_col), F.col("text"), seed).alias("draw"),
        ),
        "mix-sizes",
    )
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes).withColumnRenamed("source", "_source"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (F.col("draw") < rate - whole).cast("long")
    return measured.join(targets, F.col("source").eqNullSafe(F.col("_source"))).select(
        id_col, "source", "size", "draw", "source_size", "target", copies.alias("copies")
    )


def mix(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``.

    Only the rates, one row per source, are joined to the documents.  They are a written
    table, whose known size lets Spark broadcast them: a source's texts need not meet.
    """
    rates = (
        plan(docs, seed, id_col)
        .groupBy("source")
        .agg(F.first("source_size").alias("__llm_size"), F.first("target").alias("__llm_target"))
        .withColumnRenamed("source", "__llm_source")
    )
    rates = written(rates, "mix-rates")
    rate = F.when(F.col("__llm_size") > 0, F.col("__llm_target") / F.col("__llm_size")).otherwise(0.0)
    whole = F.floor(rate)
    copies = whole + (draw(F.col(id_col), F.col("text"), seed) < rate - whole).cast("long")
    taken = docs.join(rates, F.col("source").eqNullSafe(F.col("__llm_source")))
    repeated = taken.withColumn("__llm_copy", F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))
    return repeated.select(*docs.columns)
