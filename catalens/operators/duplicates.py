"""Codes that several entities share: how alike the sharers are, and how risky that is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalens.operators.coverage import code_groups, code_pairs
from catalens.operators.lookup import attach, attach_optional, bounded


@dataclass(frozen=True)
class RiskRules:
    """Points per agreement of a pair, the flat score of larger groups, and the cuts."""

    name: int = 40
    credit: int = 30
    length: int = 20
    comment: int = 10
    larger_group: int = 50
    tolerance: int = 5000
    high: int = 80
    medium: int = 50


RISK = RiskRules()
SHOWN = 3  # entities shown per group


def _similarity(a: Column, b: Column, size: Column, labels: tuple[str, str, str, str]) -> Column:
    same, part, different, several = labels
    a, b = F.lower(a), F.lower(b)
    pair = (
        F.when(a == b, same)
        .when(F.contains(a, b) | F.contains(b, a), part)
        .otherwise(different)
    )
    return F.when(size == 2, pair).otherwise(several)


def name_similarity(a: Column, b: Column, size: Column) -> Column:
    labels = ("Exact Match", "Partial Match", "Different Names", "Multiple Duplicates")
    return _similarity(a, b, size, labels)


def credit_similarity(a: Column, b: Column, size: Column) -> Column:
    labels = ("Same Artist", "Similar Artist", "Different Artists", "Multiple Artists")
    return _similarity(a, b, size, labels)


def length_similarity(a: Column, b: Column, size: Column, rules: RiskRules = RISK) -> Column:
    pair = (
        F.when(a.isNull() | b.isNull(), "Unknown Length")
        .when(F.abs(a - b) <= rules.tolerance, "Similar Length")
        .otherwise("Different Length")
    )
    return F.when(size == 2, pair).otherwise("Multiple Lengths")


def risk_score(a: Column, b: Column, size: Column, rules: RiskRules = RISK) -> Column:
    """Points of a pair of structs (name, credit, length, comment); NULLs never agree."""

    def points(agree: Column, worth: int) -> Column:
        return F.when(agree, worth).otherwise(0)

    pair = (
        points(F.lower(a["name"]) == F.lower(b["name"]), rules.name)
        + points(F.lower(a["credit"]) == F.lower(b["credit"]), rules.credit)
        + points(F.abs(a["length"] - b["length"]) <= rules.tolerance, rules.length)
        + points(a["comment"] == b["comment"], rules.comment)
    )
    return F.when(size == 2, pair).otherwise(rules.larger_group)


def risk_level(score: Column, rules: RiskRules = RISK) -> Column:
    return (
        F.when(score >= rules.high, "High Risk")
        .when(score >= rules.medium, "Medium Risk")
        .otherwise("Low Risk")
    )


def duplicate_candidates(
    entity: DataFrame,
    link: DataFrame,
    credits: DataFrame,
    link_key: str,
    code: str,
    rules: RiskRules = RISK,
) -> DataFrame:
    """One row per code on more than one link row, with its similarity and risk.

    ``entity`` is the population with id, name, credit (an id in ``credits``), length and
    comment; ``credits`` holds id and name.

    Sizes come from partial counts.  The first entities per code are picked by rank,
    which Spark limits to ``SHOWN`` rows per code and task before it shuffles, and only
    those of repeated codes fetch their descriptive columns.  So however large a group
    is, at most ``SHOWN`` of its rows ever meet in one place.
    """
    pairs = code_pairs(entity, link, link_key, code)
    sizes = pairs.groupBy(code).agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
    rank = F.row_number().over(Window.partitionBy(code).orderBy("id"))
    first = pairs.withColumn("rank", rank).filter(F.col("rank") <= SHOWN).join(sizes, code)

    credit_names = credits.select(F.col("id").alias("credit"), F.col("name").alias("credit_name"))
    described = first.join(
        entity.select("id", "name", "credit", "length", "comment"), "id"
    ).join(credit_names, "credit", "left")
    shown = F.struct(
        "rank", "id", "name", F.col("credit_name").alias("credit"), "length", "comment"
    )
    groups = described.groupBy(code).agg(
        F.max("size").alias("size"), F.array_sort(F.collect_list(shown)).alias("shown")
    )

    a, b, size = F.get("shown", 0), F.get("shown", 1), F.col("size")
    scored = groups.select(
        code,
        size.alias("duplicate_count"),
        name_similarity(a["name"], b["name"], size).alias("name_similarity"),
        credit_similarity(a["credit"], b["credit"], size).alias("artist_similarity"),
        length_similarity(a["length"], b["length"], size, rules).alias("length_similarity"),
        risk_score(a, b, size, rules).alias("duplicate_risk_score"),
        "shown",
    )
    return scored.select(
        code,
        "duplicate_count",
        "name_similarity",
        "artist_similarity",
        "length_similarity",
        "duplicate_risk_score",
        risk_level(F.col("duplicate_risk_score"), rules).alias("risk_level"),
        F.col("shown.id").alias("sample_ids"),
        F.col("shown.name").alias("sample_names"),
        F.col("shown.credit").alias("sample_credits"),
        F.col("shown.length").alias("sample_lengths"),
    )


def duplicate_listing(
    entity: DataFrame,
    link: DataFrame,
    credits: DataFrame,
    link_key: str,
    code: str,
    n: int,
) -> DataFrame:
    """The first ``n`` rows, by code and id, of codes that several entities share.

    Every such code has two rows or more, so the first ``ceil(n / 2)`` codes always
    cover ``n`` rows; only their rows are ranked, and only ``n`` of those per code.
    """
    pairs = code_pairs(entity, link, link_key, code)
    codes = (
        code_groups(pairs, code)
        .filter(F.col("entities") > 1)
        .select(code, F.col("rows").alias("group_size"))
        .orderBy(code)
        .limit((n + 1) // 2)
    )
    rank = F.row_number().over(Window.partitionBy(code).orderBy("id"))
    listed = (
        pairs.join(bounded(codes, n), code)
        .withColumn("group_rank", rank)
        .filter(F.col("group_rank") <= n)
        .orderBy(code, "id", "group_rank")
        .limit(n)
    )
    credit_names = credits.select(F.col("id").alias("credit"), F.col("name").alias("credit_name"))
    described = attach(listed, n, entity, "id")
    named = attach_optional(described, credit_names, "credit")
    return named.orderBy(code, "id", "group_rank").limit(n)
