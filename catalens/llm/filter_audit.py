"""How filters interact: who is removed by which, in every order, from one pass.

Each document becomes a survival word, the truth table of its filters: bit S (a set of
filters, five of them: 32 sets) is set if the document fails none of S.  Carry-save adders
sum such words by bit position: three words become a sum word and a carry word of twice the
weight, for all 32 positions at once.  The totals are the survivors of every set of filters,
per part and label.  Whatever an order does follows from them: the filters applied so far
are a set, whatever their order, so no order is ever run.

Python reads each text once and returns its failures as five bits.  Copies are found by
(text key, smallest id), where the counts are partial and only keys that occur twice are
joined back, as a written table: AQE can split a text that a third of all rows have.  Tasks
return sums of 32 counts for each part and label they have met, at most ``HELD`` at a time.

Defined cases: a null text is empty; an empty text has no words, so it is short and nothing
else (0 < 0 is false).  A null part and an empty one are the same, ''.  A null id is no
smaller than any other: it never makes a copy, and never is one.  A repeated row is not a
copy of itself, as its id is not smaller.  If labels repeat an id, any of its rows may set a
label.  Empty documents give no rows; empty labels give zeros.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.shared import map_texts, release_memory, text_key, written

LETTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80
MAX_CAPITALS = 10
MARKS = re.compile(r"[#$%&*|]")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = 1 << LETTERS.index("E")
#: Parts and labels a task adds up before it hands them on.
HELD = 4096
SUMS = "part string, good boolean, toxic boolean, survivors array<bigint>"


def text_failures(text: str | None) -> int:
    """Bits 0 to 3: too few words, too few distinct ones, too many capitals, odd marks."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: ASCII white space only
    n = len(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < MIN_DISTINCT * n) << 1
        | (100 * capitals > MAX_CAPITALS * len(text)) << 2
        | (MARKS.search(text) is not None) << 3
    )


def survival_words(filters: int) -> np.ndarray:
    """The survival word of each set of failed filters."""
    sets = np.arange(1 << filters)
    alive = (sets[:, None] & sets[None, :]) == 0
    return (alive * (1 << sets.astype(np.uint64))).sum(axis=1).astype(np.uint64)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each bit set, by carry-save addition."""
    width = words.dtype.itemsize * 8
    places = np.arange(width, dtype=words.dtype)
    counts = np.zeros(width, dtype=np.int64)
    weight = 1
    while len(words):
        carries = [words[:0]]
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate((half ^ c, words[3 * third :]))
        counts += weight * ((words[:, None] >> places) & words.dtype.type(1)).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries), 2 * weight
    return counts


def failures(
    docs: DataFrame,
    checks: Callable[[str | None], int] = text_failures,
    copy_bit: int = COPY,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """(id, part, failed) per document: the bits of ``checks``, and ``copy_bit`` if a smaller
    id has the same text."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    keep = [F.col(id_col).alias("id"), part, text_key(F.col(text_col)).alias("text_key")]
    new = {"failed": ("int", pa.int32())}
    rows = written(map_texts(docs, text_col, keep, new, lambda: lambda texts: [list(map(checks, texts))]), "audit-rows")
    firsts = rows.groupBy("text_key").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copied = written(firsts.where("first < last").select("text_key", "first"), "audit-copied")
    copy = F.when(F.col("id") > F.col("first"), F.lit(copy_bit)).otherwise(F.lit(0))
    return rows.join(copied, "text_key", "left").select("id", "part", F.col("failed").bitwiseOR(copy).alias("failed"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``good`` and ``toxic``."""
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1)).alias
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(flag("quality")("good"), flag("toxic")("toxic"))
    marked = rows.join(written(by_id, "audit-labels"), "id", "left")
    return marked.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def survivor_sums(rows: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """(part, good, toxic, survivors): partial sums of survival words; ``survivors[S]`` counts
    the documents that fail none of the filters in S."""
    table = survival_words(filters).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def flushed() -> pa.RecordBatch:
            parts, good, toxic = zip(*sums)
            columns = [pa.array(parts), pa.array(good), pa.array(toxic), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "good", "toxic", "survivors"])

        for batch in batches:
            coded = batch.column("part").dictionary_encode()
            labels = batch.column("good").to_numpy(zero_copy_only=False) + 2 * batch.column("toxic").to_numpy(zero_copy_only=False)
            group = coded.indices.to_numpy() * 4 + labels
            words = table[batch.column("failed").to_numpy()]
            order = np.argsort(group, kind="stable")
            values, starts = np.unique(group[order], return_index=True)
            for value, own in zip(values.tolist(), np.split(words[order], starts[1:])):
                key = (coded.dictionary[value // 4].as_py(), bool(value & 1), bool(value & 2))
                sums[key] = sums.get(key, 0) + positional_popcount(own)
            if len(sums) >= HELD:
                yield flushed()
                sums = {}
        if sums:
            yield flushed()
        release_memory()

    return rows.select("part", "failed", "good", "toxic").mapInArrow(run, SUMS)


def survivors(sums: DataFrame) -> DataFrame:
    """One row per part: the survivors of every set, of all, good and toxic documents."""
    each = sums.select("part", "good", "toxic", F.posexplode("survivors").alias("set", "n"))
    totals = each.groupBy("part", "set").agg(
        F.sum("n").alias("all"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0))).alias(c) for c in ("good", "toxic")]
    )
    by_set = F.sort_array(F.collect_list(F.struct("set", "all", "good", "toxic")))
    return totals.groupBy("part").agg(by_set.alias("s")).select("part", F.col("s.all"), F.col("s.good"), F.col("s.toxic"))


def effects(table: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order and step: what the step's filter does there."""
    n = len(letters)
    everything = (1 << n) - 1
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(letters))), " ")
    rows = table.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))

    def bit(place: Column) -> Column:
        letter = F.substring(F.col("filter_order"), place, F.lit(1))
        return F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)

    done = lambda last: F.aggregate(F.sequence(F.lit(1), last), F.lit(0), lambda s, i: s.bitwiseOR(bit(i)))
    before = F.when(F.col("step") == 1, F.lit(0)).otherwise(done(F.col("step") - 1))
    rows = rows.withColumns({"own": bit(F.col("step")), "before": before, "after": done(F.col("step"))})
    of = lambda name, s: F.get(F.col(name), s)
    drop = lambda name: of(name, F.col("before")) - of(name, F.col("after"))
    failing = of("all", F.lit(0)) - of("all", F.col("own"))
    others = F.lit(everything).bitwiseXOR(F.col("own"))
    # Orders in which exactly the filters of a set come before a filter.
    orders_of = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)).cast("long") for k in range(n)])
    share = lambda s: F.get(orders_of, F.bit_count(s)) * (of("all", s) - of("all", s.bitwiseOR(F.col("own"))))
    without = F.filter(F.sequence(F.lit(0), F.lit(everything)), lambda s: s.bitwiseAND(F.col("own")) == 0)
    return rows.select(
        "part",
        "filter_order",
        "step",
        of("all", F.col("after")).alias("kept"),
        drop("all").alias("removed"),
        (failing - drop("all")).alias("redundant"),
        (of("all", others) - of("all", F.lit(everything))).alias("unique_fails"),
        drop("good").alias("good_lost"),
        drop("toxic").alias("toxic_lost"),
        F.aggregate(without, F.lit(0).cast("long"), lambda a, s: a + share(s)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """The effects of the five filters on ``docs``, per part, order and step."""
    rows = labelled(failures(docs, part_col=part_col), labels)
    return effects(written(survivors(survivor_sums(rows)), "audit-survivors"))
