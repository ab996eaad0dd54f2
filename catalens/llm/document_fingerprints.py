"""Packed document fingerprints by one-permutation MinHash, and documents with their next one.

A text is its set of five-word shingles.  Every shingle is hashed once; the top bits of the
hash name one of ``BINS`` bins, and a bin keeps its least hash.  A bin that got none takes
the value of another: each bin has a cycle through all bins (a random start and odd stride),
and takes the first bin of the cycle that has a value, whatever the text.  So two sets
agree on a filled bin as often as on any other, and every empty bin draws anew (optimal
densification).  Of each value the low ``BITS`` bits are kept, packed into 64-bit words.  Two
unlike values agree on those bits by chance once in 2 ** BITS; ``likeness`` takes that out.

DataFrame functions only.  The bins of a text come from one sort of its hashes, with an entry
of no hash in every bin.  The first ``PROBES`` steps of a cycle are looked up; beyond them,
which only short texts need, the first step with a value is worked out from all bins that
have one.

``followed`` gives each document the next one in an order of ids.  Texts are shuffled once:
the order's ranges are found on ids and text keys alone, and a range gets a copy of the row
after its last one, so no range needs another.  The ranges are as many as shuffle
partitions; what reaches the driver is a sample for their bounds, a hundred keys each at most,
and their first ids and keys.

Defined cases: a null text is empty.  A text without words has the empty fingerprint, like
only to another such.  A text of fewer than five words is one shingle.  Documents of one id
follow each other by their text's 64-bit hash, greatest first; repeated rows follow each other, and
lie in one range, which spills.  Null ids come last.  A single document is its own next.
Very long texts are handled whole.  Empty tables give empty results; columns but the id and
the text are not read.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalens.llm.decontamination import WHITE, let
from catalens.llm.shared import written

SHINGLE = 5
BINS = 256
BITS = 4
SEED = 42
PROBES = 8
_PER_WORD = 64 // BITS
#: What stays of a hash beside its bin; all ones stand for no hash.
_VALUE_BITS = 64 - (BINS - 1).bit_length()
_NO_HASH = (1 << _VALUE_BITS) - 1


def _cycles(seed: int = SEED) -> tuple[list[int], list[int], list[int]]:
    """Per bin: where its cycle starts, its stride, and the stride's inverse modulo ``BINS``."""
    rng = random.Random(seed)
    starts = [rng.randrange(BINS) for _ in range(BINS)]
    strides = [rng.randrange(1, BINS, 2) for _ in range(BINS)]
    return starts, strides, [pow(s, -1, BINS) for s in strides]


def shingle_hashes(text: Column) -> Column:
    """Hashes of the shingles, in order; none for a text without words."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")
    last = lambda w: F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))
    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), lambda w: F.transform(F.sequence(F.lit(1), last(w)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), hashes).otherwise(F.array().cast("array<bigint>"))


def bin_minima(hashes: Column) -> Column:
    """The least value of each bin, null where there is none."""
    bin_of = lambda h: F.shiftright(h, _VALUE_BITS)
    none = F.array(*[F.lit((b << _VALUE_BITS) | _NO_HASH) for b in range(-BINS // 2, BINS // 2)])
    first = lambda every: F.filter(every, lambda h, i: F.coalesce(bin_of(h) != bin_of(F.get(every, i - 1)), F.lit(True)))
    least = let(F.sort_array(F.concat(hashes, none)), first)
    value = lambda h: h.bitwiseAND(F.lit(_NO_HASH))
    return F.transform(least, lambda h: F.when(value(h) != _NO_HASH, value(h)))


def filled(minima: Column) -> Column:
    """``minima`` with empty bins filled, if any bin has a value."""
    starts, strides, inverses = (F.array(*[F.lit(x) for x in xs]) for xs in _cycles())
    modulo = lambda x: x.bitwiseAND(F.lit(BINS - 1))

    def fill(every: Column, present: Column) -> Column:
        def one(value: Column, i: Column) -> Column:
            start, stride, inverse = F.get(starts, i), F.get(strides, i), F.get(inverses, i)
            step = F.array_min(F.transform(present, lambda j: modulo((j - start) * inverse)))
            probes = [F.get(every, modulo(start + stride * t)) for t in range(PROBES)]
            return F.coalesce(value, *probes, F.get(every, modulo(start + stride * step)))

        return F.transform(every, one)

    places = lambda every: F.array_compact(F.transform(every, lambda v, i: F.when(v.isNotNull(), i)))
    return let(minima, lambda every: let(places(every), lambda present: fill(every, present)))


def packed(values: Column) -> Column:
    """The low bits of the values, ``_PER_WORD`` to a 64-bit word."""
    low = lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1))
    word = lambda vs: F.aggregate(vs, F.lit(0).cast("long"), lambda a, v: F.shiftleft(a, BITS).bitwiseOR(low(v)))
    starts = F.sequence(F.lit(1), F.lit(BINS), F.lit(_PER_WORD))
    return let(values, lambda vs: F.transform(starts, lambda i: word(F.slice(vs, i, _PER_WORD))))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text, as an array of 64-bit words; empty if it has no words."""
    whole = lambda hashes: F.when(F.size(hashes) > 0, packed(filled(bin_minima(hashes)))).otherwise(F.array().cast("array<bigint>"))
    return let(shingle_hashes(text), whole)


def as_hex(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingle sets of two fingerprints."""
    ones = F.lit(sum(1 << at for at in range(0, 63, BITS)))

    def unlike(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        for shift in (1, 2):  # one bit of each group of four is left
            bits = bits.bitwiseOR(F.shiftrightunsigned(bits, shift))
        return F.bit_count(bits.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, unlike), F.lit(0), lambda s, n: s + n)
    chance = 2.0**-BITS
    estimate = F.greatest(F.lit(0.0), ((F.lit(BINS) - differ) / F.lit(float(BINS)) - chance) / (1 - chance))
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a & empty_b, F.lit(1.0)).when(empty_a | empty_b, F.lit(0.0)).otherwise(estimate)


def range_starts(keys: DataFrame) -> list[str]:
    """The first (id, key) of each range of the descending order, as JSON."""
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionByRange(n, F.desc("id"), F.desc("key"))
    firsts = dealt.select(F.spark_partition_id().alias("range"), F.struct("id", "key").alias("k")).groupBy("range").agg(F.max("k").alias("k"))
    return [r.k for r in firsts.orderBy("range").select(F.to_json("k").alias("k")).collect()]  # a row for each range


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """``n`` different numbers that a shuffle by hash deals out evenly, one to each partition in
    turn; numbers as such would meet in some partitions and miss others."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.col("id").cast("int")
    tried = spark.range(32 * parts + 1000).select(number.alias("id"), F.pmod(F.hash(number), F.lit(parts)).alias("part"))
    # A row for each partition: of so many numbers hardly one partition gets none.
    by_part = {r.part: r.id for r in tried.groupBy("part").agg(F.min("id").alias("id")).collect()}
    free = 32 * parts + 1000
    return [by_part[i] if i < parts and i in by_part else free + i for i in range(n)]


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, print) of each document, and the same of the ``next`` one: that with the next
    smaller id; the first for the last."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    starts = range_starts(written(rows.select("id", "key"), "order"))
    if not starts:
        return rows.select("id", "text", fingerprint(F.col("text")).alias("print")).withColumn("next", F.struct("text", "print"))
    kind = f"array<struct<id: {rows.schema['id'].dataType.simpleString()}, key: bigint>>"
    bounds = F.from_json(F.lit(f"[{','.join(starts)}]"), kind)
    own = F.struct("id", "key")
    steps = [1 << b for b in reversed(range(len(starts).bit_length()))]
    later = lambda at: (at < len(starts)) & (F.get(bounds, at) >= own)
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(later(at + step), at + step).otherwise(at))
    labels = even_labels(spark, len(starts))
    find = F.get(F.from_json(F.lit(json.dumps(labels)), "array<int>"), place)
    # The first row of each range, as the row after the range before.
    after = spark.createDataFrame([(labels[(i - 1) % len(starts)], s) for i, s in enumerate(starts)], "range int, start string")
    after = after.select("range", F.from_json("start", kind[len("array<") : -1]).alias("s")).select("range", F.col("s.id").alias("_id"), F.col("s.key").alias("_key"))
    after = written(after, "range-starts")  # its size is then known, and the texts stay where they are
    copies = rows.join(after, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).dropDuplicates(["range"])
    copies = copies.select("id", "key", "text", "range", F.lit(True).alias("copy"))
    both = rows.select("*", find.alias("range"), F.lit(False).alias("copy")).unionByName(copies)
    # One struct, so that a text is shuffled once and not beside itself.
    both = both.select("id", "key", "range", "copy", F.struct("text", fingerprint(F.col("text")).alias("print")).alias("own"))
    order = Window.partitionBy("range").orderBy("copy", F.desc("id"), F.desc("key"))
    return both.withColumn("next", F.lead("own").over(order)).where("not copy").select("id", "own.text", "own.print", "next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third, rounded down, replaced by as much of the beginning of
    ``following``, or by all of that."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text, edited text, the fingerprints of both, and the likeness of its
    own to the edited text's and to the next document's."""
    pairs = followed(docs, id_col, text_col)
    texts = pairs.withColumn("edited", edited(F.col("text"), F.col("next.text")))
    prints = texts.withColumn("edited_print", fingerprint(F.col("edited")))
    return prints.select(
        F.col("id").alias(id_col),
        "text",
        "edited",
        "print",
        "edited_print",
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next.print")).alias("near_next"),
    )
