"""Joins of a table in which one key may hold a large share of the rows.

The heavy keys are found first, by a frequent-items sketch: a task summarises its rows'
keys in a few kilobytes, and the summaries are merged.  Only heavy keys are salted, each by
its share of the rows, so the narrow side is copied for them alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items the sketch follows for each part that rows are dealt to.  It misses no key with more
#: than a part's rows: the error of its counts is a small fraction of that.
TRACKED = 16
#: What the sketch can follow at most.
MOST_TRACKED = 1_000_000
PARTS = "_parts"


def default_parts(df: DataFrame) -> int:
    """The parts a shuffle deals rows to in this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(rows: DataFrame, on: str, parts: int | None = None) -> DataFrame:
    """(``on``, _parts): the keys with more rows than one of ``parts`` even parts, and how many
    such parts each of them fills.

    Fewer than ``parts`` rows, whatever the table.  The counts are estimates; they decide how
    rows are dealt out and nothing else.
    """
    parts = parts or default_parts(rows)
    tracked = min(MOST_TRACKED, TRACKED * parts)
    sketch = rows.where(F.col(on).isNotNull()).agg(
        F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k({on}, {min(parts, tracked)}, {tracked})").alias("top")
    )
    each = sketch.select("total", F.explode("top").alias("t"))
    filled = F.ceil(F.col("t.count") * parts / F.col("total")).cast("bigint")
    return each.select(F.col("t.item").alias(on), filled.alias(PARTS)).where(F.col(PARTS) > 1)


def salted_join(
    many: DataFrame,
    few: DataFrame,
    on: str,
    how: str,
    spread_by: Sequence[str],
    keys_from: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``many`` joined (inner, left or left_semi) with ``few``, which is unique on ``on``.

    The rows of a heavy key are dealt out by a hash of ``spread_by`` over the parts it fills,
    and its row of ``few`` goes to each; other keys are joined as they are.  Spark's own
    splitting of skewed joins does not reach these joins: the narrow side comes straight
    from an aggregate on the key and has no shuffle of its own.  A NULL key has no match, so
    its rows are dealt out over all parts.

    ``keys_from`` is a table with about the same keys, to be read for the heavy ones where
    ``many`` takes more than a scan.
    """
    parts = parts or default_parts(many)
    # Fewer than ``parts`` rows of two numbers or a code, so the broadcast is bounded.
    heavy = F.broadcast(heavy_keys(many if keys_from is None else keys_from, on, parts))
    whole = F.when(F.col(on).isNull(), F.lit(parts)).otherwise(F.coalesce(PARTS, F.lit(1))).cast("bigint")
    salt = F.pmod(F.xxhash64(*spread_by), whole).alias("_salt")
    dealt = many.join(heavy, on, "left").select(*many.columns, salt)
    every = F.sequence(F.lit(0).cast("bigint"), F.coalesce(PARTS, F.lit(1).cast("bigint")) - 1)
    copied = few.join(heavy, on, "left").select(*few.columns, F.explode(every).alias("_salt"))
    return dealt.join(copied, [on, "_salt"], how).drop("_salt")
