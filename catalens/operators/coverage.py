"""How many entities carry a code, and which codes are shared."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.functions.numeric import pct
from catalens.operators import bitmaps
from catalens.operators.evidence import Evidence, observe
from catalens.operators.skew import salted_join


def code_pairs(
    entity: DataFrame, link: DataFrame, link_key: str, code: str, carry: Sequence[str] = ()
) -> DataFrame:
    """Link rows with a code whose entity belongs to the population: (id, code, carry..).

    The population's ``id`` is unique, so this neither multiplies nor repeats rows.
    """
    codes = link.where(f"{code} is not null").selectExpr(f"{link_key} as id", code)
    return codes.join(entity.select("id", *carry), "id")


def coded_state(
    entity: DataFrame, link: DataFrame, link_key: str, carry: Sequence[str] = ()
) -> DataFrame:
    """The population with a 0/1 flag, ``coded``: does any link row name the entity."""
    return observe(entity, [Evidence(link, link_key, {"coded": None})], carry=carry)


def membership(entity: DataFrame, link: DataFrame, link_key: str) -> DataFrame:
    """Who is in the population (``member``) and who is named by a link (``linked``), as bitmaps.

    Worth storing: it is a sixty-fourth of the ids, and its size then decides how link rows
    meet it.
    """
    return bitmaps.id_sets({"member": (entity, "id"), "linked": (link, link_key)})


def member_pairs(words: DataFrame, link: DataFrame, link_key: str, code: str) -> DataFrame:
    """``code_pairs`` that carry nothing, by the bitmaps of ``membership``."""
    return bitmaps.members(_coded(link, link_key, code), "id", words, "member")


def _coded(link: DataFrame, link_key: str, code: str) -> DataFrame:
    return link.where(f"{code} is not null").selectExpr(f"{link_key} as id", code)


def code_groups(pairs: DataFrame, code: str) -> DataFrame:
    """Per code: how many distinct entities share it, and how many rows say so.

    Rows are counted before anything is shuffled; distinct entities are counted by bitmap.
    """
    key = F.col("id").cast("bigint")
    bits = pairs.select(code, bitmaps.word_of(key).alias(bitmaps.WORD), bitmaps.bit_of(key).alias("bits"))
    words = bits.groupBy(code, bitmaps.WORD).agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("rows"))
    return words.groupBy(code).agg(F.sum(F.bit_count("bits")).alias("entities"), F.sum("rows").alias("rows"))


def code_ranges(pairs: DataFrame, code: str) -> DataFrame:
    """(code, low, high, rows): a code is shared if its least and greatest entity differ.

    One shuffle of one row per code and task, whatever the codes and their repeats.
    """
    return pairs.groupBy(code).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows"))


def coverage(
    entity: DataFrame,
    link: DataFrame,
    link_key: str,
    code: str,
    entities: str,
    stored: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """One row of coverage and duplicate figures; ``entity`` is the filtered population.

    Three steps, each of which ``stored`` may write and read back: the bitmaps of who is there,
    one row per code, and the codes whose entities have to be counted one by one.  Stored,
    the first and last have a size that Spark knows, and as long as it lets them be broadcast
    the only shuffle is that of one row per code and task; the link table is scanned twice.

    An entity counts as covered when a link row names it, even one without a code;
    codes and duplicates look at non-NULL codes only.
    """
    zero = "cast(0 as bigint)"
    words = stored(membership(entity, link, link_key), f"{entities}-members")
    member, linked = F.col("member"), F.col("linked")
    covered = words.agg(bitmaps.size(member).alias("total"), bitmaps.size(member.bitwiseAND(linked)).alias("coded")).selectExpr(
        "total", "coded", f"{zero} as codes", f"{zero} as shared", f"{zero} as sharing"
    )
    pairs = member_pairs(words, link, link_key, code)
    ranges = stored(code_ranges(pairs, code), f"{entities}-codes")
    # Two rows of different entities are two entities; more rows may repeat some.
    codes = ranges.selectExpr(
        f"{zero} as total",
        f"{zero} as coded",
        "count(*) as codes",
        "count_if(low < high) as shared",
        "coalesce(sum(case when low < high and rows = 2 then 2L end), 0L) as sharing",
    )
    several = stored(ranges.where("low < high and rows > 2").select(code), f"{entities}-several")
    counted = bitmaps.distinct_ids(pairs.join(several, code, "left_semi"), code, "id").selectExpr(
        f"{zero} as total", f"{zero} as coded", f"{zero} as codes", f"{zero} as shared", "coalesce(sum(ids), 0L) as sharing"
    )
    # One-row frames become one row by addition, which needs no join.
    one_row = covered.unionByName(codes).unionByName(counted).groupBy().sum().toDF(*covered.columns)
    return coverage_row(one_row, code, entities)


def coverage_row(figures: DataFrame, code: str, entities: str) -> DataFrame:
    """The row of a coverage KPI from its counts: total, coded, codes, shared, sharing."""
    with_code, without = f"{entities}_with_{code}", f"{entities}_without_{code}"
    return figures.select(
        F.col("total").alias(f"total_{entities}"),
        F.col("coded").alias(with_code),
        F.expr("total - coded").alias(without),
        F.col("codes").alias(f"unique_{code}s"),
        pct("coded", "total").alias(f"{code}_coverage_pct"),
        pct("total - coded", "total").alias(f"missing_{code}_pct"),
        F.col("shared").alias(f"duplicate_{code}_count"),
        F.col("sharing").alias(f"total_duplicate_{entities}"),
        pct("sharing", "coded").alias("duplicate_rate_pct"),
    )


def shared_codes(pairs: DataFrame, code: str) -> DataFrame:
    """The codes more than one entity carries."""
    return code_ranges(pairs, code).where("low < high").select(code)


def code_status(
    entity: DataFrame,
    link: DataFrame,
    link_key: str,
    code: str,
    labels: tuple[str, str, str],
    words: DataFrame | None = None,
) -> DataFrame:
    """One row per (entity, code) with a status of (missing, duplicate, unique).

    Statuses are worked out on the link rows, before the entities join in, so the many
    entities without a code never travel under one NULL key.
    """
    missing, duplicate, unique = labels
    status = f"{code}_status"
    rows = link.select(F.col(link_key).alias("id"), code)
    words = membership(entity, link, link_key) if words is None else words
    pairs = member_pairs(words, link, link_key, code)
    shared = shared_codes(pairs, code).withColumn("shared", F.lit(True))
    judged = (
        salted_join(rows.filter(F.col(code).isNotNull()), shared, code, "left", ["id"])
        .select("id", code, F.when(F.col("shared"), duplicate).otherwise(unique).alias(status))
    )
    blank = rows.filter(F.col(code).isNull()).select("id", code, F.lit(unique).alias(status))
    return entity.join(judged.unionByName(blank), "id", "left").withColumn(
        status, F.coalesce(F.col(status), F.lit(missing))
    )


def coverage_gaps(
    entity: DataFrame,
    link: DataFrame,
    link_key: str,
    code: str,
    labels: tuple[str, str],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every entity without a code and every (entity, shared code): the rows to sample from.

    Columns: sample_type (one of ``labels``), id, code (NULL for the former), carry...
    """
    missing, duplicate = labels
    state = coded_state(entity, link, link_key, carry)
    without = state.where("coded = 0").selectExpr(
        f"'{missing}' as sample_type", "id", f"cast(null as string) as {code}", *carry
    )
    pairs = code_pairs(entity, link, link_key, code, carry)
    # A placeholder code may be held by a large share of all entities.
    sharing = salted_join(
        pairs, shared_codes(pairs, code), code, "left_semi", ["id"], keys_from=_coded(link, link_key, code)
    ).selectExpr(f"'{duplicate}' as sample_type", "id", code, *carry)
    return without.union(sharing)
