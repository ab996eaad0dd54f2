"""Two-phase confidence: a categorical rule and a weighted score over 0/1 flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.numeric import mean_milli, milli, pct

SCORE = "decimal(4,3)"
LEVELS = ("High", "Medium", "Low")
PHASES = ("phase1", "phase2")


@dataclass(frozen=True)
class ConfidenceRules:
    """``flags``: flag -> name of its coverage column; ``medium``: any of these suffices.

    Weights and cuts are decimal text, as 0.3 is no exact double.
    """

    entities: str
    flags: Mapping[str, str]
    weights: Mapping[str, str]
    medium: Sequence[Sequence[str]]
    high_cut: str = "0.8"
    medium_cut: str = "0.4"

    @property
    def counted(self) -> dict[str, str]:
        """Flag -> name of its count column, e.g. has_isrc -> works_with_isrc."""
        return {name: f"{self.entities}_{name.replace('has_', 'with_')}" for name in self.flags}


def _all(flags: Sequence[str]) -> str:
    return f"({' and '.join(f'{flag} = 1' for flag in flags)})"


def categorical_level(rules: ConfidenceRules) -> Column:
    """High when every flag is set, Medium when any listed combination is, else Low."""
    medium = " or ".join(_all(combo) for combo in rules.medium)
    return F.expr(
        f"case when {_all(list(rules.flags))} then 'High' when {medium} then 'Medium' "
        "else 'Low' end"
    )


def weighted_score(rules: ConfidenceRules) -> Column:
    """Sum of the weights of the set flags, exact, to 3 decimals."""
    terms = " + ".join(f"{Decimal(weight)}BD * {name}" for name, weight in rules.weights.items())
    return F.expr(f"cast(round({terms}, 3) as {SCORE})")


def score_level(score: str, rules: ConfidenceRules) -> Column:
    return F.expr(
        f"case when {score} >= {rules.high_cut}BD then 'High' "
        f"when {score} >= {rules.medium_cut}BD then 'Medium' else 'Low' end"
    )


def scored(flags: DataFrame, rules: ConfidenceRules) -> DataFrame:
    """The flag frame with both levels and the score added."""
    return flags.select(
        "*",
        categorical_level(rules).alias("phase1_confidence_level"),
        weighted_score(rules).alias("phase2_confidence_score"),
    ).select(
        "*", score_level("phase2_confidence_score", rules).alias("phase2_confidence_level")
    )


def confidence(flags: DataFrame, rules: ConfidenceRules) -> DataFrame:
    """One summary row over the population.

    Entities with equal flags score alike, so they are counted per flag combination
    first: a handful of rows per task is all that is shuffled and scored.
    """
    names = list(rules.flags)
    combos = scored(flags.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), rules)
    levels = [(phase, level) for phase in PHASES for level in LEVELS]

    def held(condition: str) -> str:
        return f"coalesce(sum(case when {condition} then n end), 0)"

    sums = combos.selectExpr(
        "coalesce(sum(n), 0) as total",
        f"sum({milli('phase2_confidence_score')} * n) as milli",
        *[f"{held(f'{p}_confidence_level = {lv!r}')} as {p}_{lv.lower()}" for p, lv in levels],
        *[f"{held(f'{name} = 1')} as {name}" for name in names],
    )

    def phase(which: str) -> list[Column]:
        keys = [f"{which}_{level.lower()}" for level in LEVELS]
        return [F.col(k).alias(f"{k}_count") for k in keys] + [
            pct(k, "total").alias(f"{k}_pct") for k in keys
        ]

    # Judged on the exact mean, not on the rounded one; an empty population is Low.
    overall = (
        f"case when milli >= total * {rules.high_cut}BD * 1000 then 'High Confidence' "
        f"when milli >= total * {rules.medium_cut}BD * 1000 then 'Medium Confidence' "
        "else 'Low Confidence' end"
    )
    return sums.select(
        F.col("total").alias(f"total_{rules.entities}"),
        *phase("phase1"),
        *phase("phase2"),
        mean_milli("milli", "total").alias("average_phase2_score"),
        *[F.col(name).alias(column) for name, column in rules.counted.items()],
        *[pct(name, "total").alias(column) for name, column in rules.flags.items()],
        F.expr(overall).alias("overall_confidence_level"),
    )
