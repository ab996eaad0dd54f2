"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Texts are reduced to 64-bit fingerprints.  Every distinct fingerprint emits itself and all
fingerprints within half the radius; two that lie within the radius meet in some variant.
A variant is shared by 65 distinct fingerprints at most (radius 2), so no group is large,
however many documents share a fingerprint.  Within a group each member is paired with
the smallest one; the pairs are deduplicated, verified, and joined into components by
alternating large-star and small-star rounds, each written to the shared folder.  The
smallest neighbours are written too: a side that came straight from an aggregate on the
join's key would have no shuffle of its own, and AQE could not split a hub of many edges.

Defined cases: a null or white-space text has fingerprint zero and links like any other.
Texts of fewer than ``SHINGLE`` words are one shingle.  A null id gets a row; it never
names a component unless all ids in it are null.  Repeated rows share their component.
Very long texts are hashed whole, their bits counted in chunks.  Empty tables give empty
results.  Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalens.llm.shared import map_texts, text_key, written

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 14


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space
    joined = b" ".join(words)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype=np.uint64
    )


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp) per row; fp holds the 64 bits as a signed long."""
    keep = [F.col(id_col), text_key(F.col(text_col)).alias("text_key")]

    def start():
        return lambda texts: [[_signed(simhash(shingle_hashes(t))) for t in texts]]

    return map_texts(docs, text_col, keep, {"fp": ("bigint", pa.int64())}, start)


def close_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): each distinct ``fp`` with the smallest one it meets in a variant."""
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)).cast("long")) for i in range(64)])
    variants = prints.select("fp").distinct().select("fp", F.explode(ball).alias("variant"))
    met = variants.withColumn("low", F.min("fp").over(Window.partitionBy("variant")))
    pairs = met.where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def star_components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node with a pair; root is the smallest node reachable.

    Large-star links each larger neighbour of a node to its smallest neighbour, small-star
    each smaller one; repeated, all trees become stars.  The number of rounds grows with
    the logarithm of the longest chain.
    """
    edges = written(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        edges = written(small.where("u <> v").distinct(), "edges")


def components(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``prints`` with ``component_id``, the smallest id reachable over close fingerprints."""
    roots = written(star_components(close_pairs(prints)), "roots")
    lowest = prints.groupBy("fp").agg(F.min(id_col).alias("_id"))
    named = lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "_id"
    )
    named = written(named, "named")
    ids = written(named.groupBy("root").agg(F.min("_id").alias("component_id")), "ids")
    by_print = named.join(ids, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_key, fp, root (of its group) and component_id."""
    return components(written(fingerprints(docs, id_col, text_col), "prints"), id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group: the smallest id (then text key, nulls last).

    Winners are chosen on ids alone; texts are shuffled once, to meet their winners.
    """
    rows = near_duplicates(docs, id_col, text_col)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_key").alias("text_key"))
    best = rows.groupBy("root").agg(F.min(order).alias("w")).select("w.id", "w.text_key")
    return rows_chosen(docs, best, id_col, text_col)


def rows_chosen(docs: DataFrame, best: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each id and text key of ``best``."""
    best = best.select(F.col("id").alias("__llm_id"), F.col("text_key").alias("__llm_key")).distinct()
    keyed = docs.withColumn("__llm_text_key", text_key(F.col(text_col)))
    kept = keyed.join(best, F.col(id_col).eqNullSafe(F.col("__llm_id")) & (F.col("__llm_text_key") == F.col("__llm_key")))
    # Rows with the same id and text are one document written twice.
    return kept.dropDuplicates(["__llm_id", "__llm_key"]).select(*docs.columns)
