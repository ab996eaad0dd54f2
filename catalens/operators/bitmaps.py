"""Exact sets of ids as bitmaps, 64 ids to a word.

A set of ids is rows (word, bits): the ids that share all but their last six bits are one
row, and sets are united by ``bit_or``.  Ids that lie close together, as serial keys do,
take a sixty-fourth of the rows that a list of ids takes; ids far apart take a row each, as
in a list, and never more.  Words are plain longs, so Spark folds them in generated code and
partly before the shuffle.  (Spark's own bitmap aggregates hold 4 kB for every 32,768 ids
that have one at all, and fall back to sorting beyond 128 such ranges a task.)
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "_word"
_IDS = 6


def word_of(key: Column) -> Column:
    return F.shiftright(key, _IDS)


def bit_of(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit((1 << _IDS) - 1)).cast("int"))


def id_sets(sets: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(_word, a column of bits per set): the ids in the given column of each frame.

    NULL ids belong to no set.
    """
    names = list(sets)

    def part(name: str) -> DataFrame:
        rows, column = sets[name]
        key = F.col(column).cast("bigint")
        bits = [(bit_of(key) if n == name else F.lit(0).cast("bigint")).alias(n) for n in names]
        return rows.where(F.col(column).isNotNull()).select(word_of(key).alias(WORD), *bits)

    return united(reduce(DataFrame.unionByName, map(part, names)), names)


def united(words: DataFrame, names: Sequence[str]) -> DataFrame:
    """Words of several origins as one row each."""
    return words.groupBy(WORD).agg(*[F.bit_or(n).alias(n) for n in names])


def size(bits: Column) -> Column:
    """An aggregate: how many ids a column of bits holds."""
    return F.coalesce(F.sum(F.bit_count(bits)), F.lit(0)).cast("bigint")


def members(rows: DataFrame, column: str, words: DataFrame, name: str) -> DataFrame:
    """The ``rows`` whose id in ``column`` belongs to the set ``name`` of ``words``.

    Where ``words`` is a stored table, Spark knows its size, and a set that its threshold lets
    it broadcast costs no shuffle of the rows.
    """
    held = words.where(F.col(name) != 0).select(F.col(WORD), F.col(name).alias("_held"))
    key = F.col(column).cast("bigint")
    met = rows.join(held, word_of(key) == F.col(WORD))
    return met.where(bit_of(key).bitwiseAND(F.col("_held")) != 0).select(*rows.columns)


def distinct_ids(pairs: DataFrame, by: str, column: str) -> DataFrame:
    """(``by``, ids): how many distinct ids of ``column`` each value of ``by`` has."""
    key = F.col(column).cast("bigint")
    bits = pairs.select(by, word_of(key).alias(WORD), bit_of(key).alias("_bits"))
    words = bits.groupBy(by, WORD).agg(F.bit_or("_bits").alias("_bits"))
    return words.groupBy(by).agg(F.sum(F.bit_count("_bits")).alias("ids"))
