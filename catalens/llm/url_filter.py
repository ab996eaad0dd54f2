"""URL filter: a blocked Bloom filter in front of an exact join, with host and path rules.

The list of canonical URLs is folded into a blocked Bloom filter held as a table: one row
per 256-bit block.  A URL looks at one block only.  URLs whose bits are all set go on to
the exact hash join with the list, which removes the false positives; all others are
known not to be listed.  DataFrame functions only.

Sizes: the filter has ``BITS_PER_URL`` bits for each listed URL, so it is about a tenth of
the list.  Neither side is hinted for broadcast; Spark's own size threshold decides, and
beyond it both joins are shuffled on hashes of the URL.  List and filter are written
tables, so each join has a shuffle on either side and AQE can split a URL of many rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path, matches no
rule and is never listed.  Repeated pages are judged one by one.  An empty list allows all.
Of several fitting rules of one length the one given last counts.  Very long URLs are
hashed and compared whole.
Only the id and URL columns are read, so further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.llm.shared import written

BITS_PER_URL = 16
BLOCK_BITS = 256
WORDS = BLOCK_BITS // 64
PROBES = 6
SECOND_SEED = 7

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HOST_AND_PATH = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY_PART = r"(?s)^[^?#]*\?([^#]*)"
TRACKING = r"(^|&)(utm_[^&=]*|ref)(=[^&]*)?"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        subdomain = host.endswith(f".{self.host}")
        return ((host == self.host) | subdomain) & path.startswith(self.path)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), HOST_AND_PATH, 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), HOST_AND_PATH, 2)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, parameters sorted and without
    trackers; no scheme, no fragment.  Null where there is no host."""
    query = F.regexp_replace(F.regexp_extract(url, QUERY_PART, 1), TRACKING, "")
    pairs = F.array_sort(F.filter(F.split(query, "&"), lambda p: p != ""))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, tail))


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    """The bits of ``url`` in each word of its block."""
    second = F.xxhash64(url, F.lit(SECOND_SEED))
    bits = [F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]

    def mask(word: int) -> Column:
        out = F.lit(0).cast("long")
        for bit in bits:
            place = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))
            here = F.when(F.shiftright(bit, 6) == word, place).otherwise(F.lit(0).cast("long"))
            out = out.bitwiseOR(here)
        return out

    return [mask(w) for w in range(WORDS)]


def bloom_table(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """One row (block, w0..w3) for every block with a bit set."""
    url = F.col(url_col)
    hashed = listed.select(_block(url, blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(url))])
    return hashed.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_flags(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``pages`` (with a column ``canonical``) plus ``listed``: whether the URL is on the list.

    ``listed`` has one column ``canonical``; nulls and repeats in it count for nothing.
    """
    listed = written(listed.select("canonical").where("canonical is not null").distinct(), "listed")
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    bloom = written(bloom_table(listed, "canonical", blocks), "bloom")
    url = F.col("canonical")
    probed = pages.withColumns(
        {"_block": _block(url, blocks)} | {f"_m{i}": m for i, m in enumerate(_masks(url))}
    ).join(bloom.withColumnRenamed("block", "_block"), "_block", "left")
    possible = url.isNotNull()
    for i in range(WORDS):
        possible = possible & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}"))
    probed = probed.select(*pages.columns, possible.alias("_possible"))
    clear = probed.where("not _possible").select(*pages.columns, F.lit(False).alias("listed"))
    exact = (
        probed.where("_possible")
        .join(listed.withColumn("_on", F.lit(True)), "canonical", "left")
        .select(*pages.columns, F.col("_on").isNotNull().alias("listed"))
    )
    return clear.unionByName(exact)


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, the longest fitting rule (else null), the
    verdict (the rule's; else block if the URL is listed, else allow), canonical, listed."""
    url = F.col(url_col)
    parts = pages.select(
        F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical")
    )
    flagged = listed_flags(parts, listed)
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("listed"), "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return flagged.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"), "canonical", "listed")
