"""Benchmark decontamination by SimHash over item-sized windows.

An item and a window of a document are multisets of five-word shingles; their similarity is
the weighted Jaccard of the shingle counts.  For an item of L words only windows of L words
are looked at (the whole document if it is shorter).  Windows and items get 64-bit SimHash
fingerprints.  Candidates come from multi-index blocks: of ``len(BLOCKS)`` blocks, two
fingerprints within ``RADIUS`` bits must have one that differs in at most ``RADIUS //
len(BLOCKS)`` bits, so every item emits all such variants of every block, and windows meet
them in an equi-join on (L, block, value).  Candidates are verified exactly.

Which windows are fingerprinted loses none of the pairs at ``THRESHOLD`` or above.  Moving
the start of a window on to its first shingle that occurs in the benchmark keeps all
shingles it shares with any item, so windows starting at such a shingle (or the last window
of the document) are enough; and of n shingles, a window needs 2tn / (1 + t) that occur in
items of its length.  The radius is wide for the threshold: at a similarity of 0.8 the
expected distance is 10 bits with a deviation of 3.

DataFrame functions only.  Texts are looked at in place; shuffled are the shared shingles
and, once, the texts on their way to the windows found.  The benchmark's shingles are
broadcast while they number at most ``BROADCAST_SHINGLES``, else joined by a shuffle.  Keys are 128 bits of the text, so copies of a text are looked up once.

Defined cases: null texts and items are empty; empty ones match nothing.  Texts or items of
fewer than five words are one shingle; for the lengths of such items that occur, the
windows of that length are looked up besides, so they are found within longer texts.  Repeated documents and items are all reported.
Of several such windows at the same similarity the first is reported.  Very long texts are looked
at whole, in all their windows.  Without documents or without items nothing matches.  Other
columns are not read, and ``clean`` passes them on.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.shared import written

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 23
#: (first bit, width) of each block.
BLOCKS = tuple((8 * i, 8) for i in range(8))
#: Shingles of the benchmark that may be broadcast: about 130 MB as a hash table.
BROADCAST_SHINGLES = 2_000_000
WHITE = r"[\x20\x09-\x0D]+"
SECOND_SEED = 7


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once: the optimizer may otherwise put its
    expression in place of every reference, also within a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _positions(words: Column) -> Column:
    """1-based starts of the shingles; none for no words."""
    last = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(word_hashes: Column) -> Column:
    return let(word_hashes, lambda w: F.transform(_positions(w), lambda i: F.xxhash64(F.slice(w, i, SHINGLE))))


def short_hashes(word_hashes: Column, n_words: int) -> Column:
    """Hashes of all windows of ``n_words`` words, as an item of so few words is hashed."""

    def windows(w: Column) -> Column:
        last = F.greatest(F.size(w) - (n_words - 1), F.lit(1))
        places = F.when(F.size(w) >= n_words, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(w, i, n_words)))

    return let(word_hashes, windows)


def shingles(words: Column) -> Column:
    return let(words, lambda w: F.transform(_positions(w), lambda i: F.array_join(F.slice(w, i, SHINGLE), " ")))


def numbered(values: Column) -> Column:
    """Each value with how often it came before, so that multisets become sets."""

    def all_numbered(every: Column) -> Column:
        def number(value: Column, i: Column) -> Column:
            before = F.filter(F.slice(every, F.lit(1), i), lambda v: v == value)
            return F.concat(F.size(before).cast("string"), F.lit(" "), value)

        return F.transform(every, number)

    return let(values, all_numbered)


def simhash(hashes: Column) -> Column:
    """Bits set in over half of the hashes."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def folded(hs: Column) -> Column:
        def bit(b: Column) -> Column:
            count = F.aggregate(hs, zero, lambda a, h: a + F.call_function("shiftright", h, b).bitwiseAND(one))
            return F.when(count * 2 > F.size(hs), F.call_function("shiftleft", one, b)).otherwise(zero)

        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), zero, lambda a, b: a.bitwiseOR(b))

    return let(hashes, folded)


def block_values(fp: Column) -> Column:
    """An array of (block, value)."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
            for i, (at, width) in enumerate(BLOCKS)
        ]
    )


def flips(width: int, most: int) -> list[int]:
    """All masks of at most ``most`` bits."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(width), k)]


def fingerprinted(df: DataFrame) -> DataFrame:
    """``df`` (with ``grams``) with the fingerprint ``fp`` and numbered grams."""
    hashes = F.transform("grams", lambda g: F.xxhash64(g))
    return df.withColumns({"fp": simhash(hashes), "grams": numbered(F.col("grams"))})


def prepared_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, n_words, words) of the items with a word."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    return words.where(F.size("words") > 0).withColumn("n_words", F.size("words"))


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with 128 bits of the text, k1 and k2."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__llm_k1": F.xxhash64(text), "__llm_k2": F.xxhash64(F.lit(SECOND_SEED), text)})


KEY = ["__llm_k1", "__llm_k2"]


def promising_windows(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """(key, n_words, start): the windows that can reach the threshold, per distinct text."""
    own = items.withColumn("hash", F.explode(shingle_hashes(F.transform("words", lambda w: F.xxhash64(w)))))
    own = written(own.select("hash", "n_words").distinct(), "benchmark-shingles")
    # At most SHINGLE - 1 lengths.
    short = sorted(r.n_words for r in own.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect())
    if own.count() <= BROADCAST_SHINGLES:
        own = F.broadcast(own)

    def placed_hashes(hashes_of: Callable[[Column], Column]) -> DataFrame:
        def hashed(words: Column) -> Column:
            return F.struct(F.size(words).alias("length"), hashes_of(F.transform(words, lambda w: F.xxhash64(w))).alias("all"))

        texts = keyed(docs.select(text_col), text_col).select(*KEY, let(words_of(F.col(text_col)), hashed).alias("hashes"))
        return texts.select(*KEY, F.col("hashes.length").alias("length"), F.posexplode("hashes.all").alias("place", "hash"))

    placed = placed_hashes(shingle_hashes)
    for n in short:
        placed = placed.unionByName(placed_hashes(lambda hashes, n=n: short_hashes(hashes, n)))
    hits = placed.join(own, "hash")
    # No more places than the text has words; partial sets keep copies of a text apart from each other.
    places = hits.groupBy(*KEY, "length", "n_words").agg(F.sort_array(F.collect_set("place")).alias("places"))
    size = F.least("length", "n_words")
    grams = F.greatest(size - (SHINGLE - 1), F.lit(1))
    item_grams = F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))
    # Of g and n shingles with m shared: m / (g + n - m) >= t.
    needed = F.ceil((grams + item_grams) * (THRESHOLD / (1 + THRESHOLD)) - 1e-9).cast("int")
    found = places.withColumns({"needed": F.greatest(needed, F.lit(1)), "grams": item_grams})

    def enough(place: Column, i: Column) -> Column:
        last = F.get("places", i + F.col("needed") - 1)
        return last < place + F.col("grams")

    latest = F.greatest(F.col("length") - F.col("n_words"), F.lit(0))
    starts = F.transform(F.filter("places", enough), lambda p: F.least(p, latest))
    return found.select(*KEY, "n_words", F.explode(F.array_distinct(starts)).alias("start"))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for every window and item at the threshold: key, doc_id, item_id, similarity,
    start_word and n_words of the window."""
    own = written(prepared_items(items, item_id_col, item_text_col), "benchmark-items")
    starts = written(promising_windows(docs, own, text_col), "window-starts")
    # The few windows are the hashed side, so the texts are not sorted.
    texts = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    cut = F.slice(words_of(F.col("text")), F.col("start") + 1, F.col("n_words"))
    windows = texts.join(starts.hint("shuffle_hash"), KEY).select(*KEY, "doc_id", "n_words", "start", cut.alias("words"))
    number = F.monotonically_increasing_id()
    windows = windows.select(*KEY, "doc_id", "n_words", "start", F.size("words").alias("size"), shingles(F.col("words")).alias("grams"))
    windows = written(fingerprinted(windows).withColumn("window_no", number), "windows")
    own = own.select("item_id", "n_words", shingles(F.col("words")).alias("grams"))
    own = written(fingerprinted(own).withColumn("item_no", number), "benchmark-prints")

    index = own.select("item_no", "n_words", F.col("fp").alias("item_fp"), F.inline(block_values(F.col("fp"))))
    variants = F.lit(None).cast("array<int>")
    for width in {w for _, w in BLOCKS}:
        here = F.col("block").isin([i for i, (_, w) in enumerate(BLOCKS) if w == width])
        variants = F.when(here, F.array(*map(F.lit, flips(width, RADIUS // len(BLOCKS))))).otherwise(variants)
    index = index.withColumn("flip", F.explode(variants)).withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    index = index.select("item_no", "n_words", "item_fp", "block", "value")
    probes = windows.select("window_no", "n_words", "fp", F.inline(block_values(F.col("fp"))))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS
    pairs = probes.join(index, ["n_words", "block", "value"]).where(close).select("window_no", "item_no").distinct()

    theirs = own.select("item_no", "item_id", F.col("grams").alias("item_grams"))
    both = pairs.join(windows, "window_no").join(theirs, "item_no")
    shared = F.size(F.array_intersect("grams", "item_grams"))
    similarity = shared / (F.size("grams") + F.size("item_grams") - shared)
    return (
        both.withColumn("similarity", similarity)
        .where(F.col("similarity") >= THRESHOLD)
        .select(*KEY, "doc_id", "item_id", "similarity", F.col("start").alias("start_word"), F.col("size").alias("n_words"))
    )


def contaminated(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """One row for each document and item at the threshold: doc_id, item_id, similarity,
    start_word, n_words of the best window.  Clean documents have none."""
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("before"), "n_words")).alias("best")
    found = matches(docs, items, **columns).groupBy("doc_id", "item_id").agg(best)
    return found.select(
        "doc_id", "item_id", "best.similarity", (-F.col("best.before")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words")
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **columns: str) -> DataFrame:
    """The documents without a match, columns as they are."""
    found = matches(docs, items, text_col=text_col, **columns)
    keys = written(found.select(*KEY).distinct(), "contaminated")
    return keyed(docs, text_col).join(keys, KEY, "left_anti").select(*docs.columns)
