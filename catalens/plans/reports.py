"""Reports over the KPIs: overviews, rankings, distributions and pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.functions.numeric import mean_milli, milli, pct
from catalens.functions.sampling import DEFAULT_SEED, seeded_top_k
from catalens.operators.identifiers import presence_labels
from catalens.operators.lookup import attach
from catalens.operators.overview import row_counts
from catalens.operators.paged import name_pages
from catalens.plans import kpis
from catalens.plans.flags import settled, shared_facts
from catalens.sources.catalogue import Catalogue

ENTITIES = {"Artist": "artist", "Work": "work", "Recording": "recording", "Release": "release"}

# The report's column names.
DUPLICATE_COLUMNS = [
    "isrc",
    "duplicate_count",
    "duplicate_risk_score",
    "risk_level",
    "name_similarity",
    "artist_similarity",
    "length_similarity",
]

# Lower cut of each score bin, highest first, and the labels of the bins.
SCORE_BINS = {
    "0.8": "0.8-1.0 (High)",
    "0.6": "0.6-0.8",
    "0.4": "0.4-0.6 (Medium)",
    "0.2": "0.2-0.4",
}
LOWEST_BIN = "0.0-0.2 (Low)"

# Column groups of the duplicate pivot.
CREDIT_SIMILARITIES = {
    "Same Artist": "same_artist",
    "Similar Artist": "similar_artist",
    "Different Artists": "different_artists",
    "Multiple Artists": "multiple_artists",
}


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- overviews --------------------------------------------------------------------


def kpi_overview(cat: Catalogue) -> DataFrame:
    """Coverage and duplicate percentages of the three main KPIs side by side."""

    def row(label: str, df: DataFrame, cover: str, duplicate: Column, total: str, covered: Column):
        return df.select(
            F.lit(label).alias("kpi_name"),
            F.col(cover).alias("coverage_percentage"),
            duplicate.cast("double").alias("duplicate_percentage"),
            F.col(total).alias("total"),
            covered.alias("covered"),
        )

    rate = F.col("duplicate_rate_pct")
    return _union(
        [
            row(
                "ISRC Coverage",
                kpis.kpi_isrc_coverage(cat),
                "isrc_coverage_pct",
                rate,
                "total_recordings",
                F.col("recordings_with_isrc"),
            ),
            row(
                "ISWC Coverage",
                kpis.kpi_iswc_coverage(cat),
                "iswc_coverage_pct",
                rate,
                "total_works",
                F.col("works_with_iswc"),
            ),
            row(
                "Artist ID Completeness",
                kpis.party_missing_ids_artist(cat),
                "overall_id_completeness_pct",
                F.lit(0),
                "total_artists",
                F.col("artists_with_ipi") + F.col("artists_with_isni"),
            ),
        ]
    )


def table_row_counts(cat: Catalogue) -> DataFrame:
    return row_counts(cat)


def sample_sizes(cat: Catalogue, seed: int = DEFAULT_SEED) -> DataFrame:
    """How many rows each of the main sample views holds."""
    samples = {
        "ISRC Samples": kpis.kpi_isrc_coverage_samples(cat, seed=seed),
        "Artist Samples": kpis.confidence_artist_samples(cat, seed=seed),
        "Duplicate ISRC Samples": kpis.dup_isrc_candidates_samples(cat, seed=seed),
        "Missing IDs Samples": kpis.party_missing_ids_artist_samples(cat, seed=seed),
    }
    return row_counts(samples).withColumnsRenamed(
        {"table_name": "sample_type", "row_count": "sample_count"}
    )


# --- rankings and filtered samples ------------------------------------------------


def top_duplicate_isrcs(cat: Catalogue, n: int = 20) -> DataFrame:
    """The riskiest shared ISRCs."""
    return (
        kpis.dup_isrc_unordered(cat)
        .select(*DUPLICATE_COLUMNS)
        .orderBy(F.desc("duplicate_risk_score"), F.desc("duplicate_count"), "isrc")
        .limit(n)
    )


def artists_with_least_ids(
    cat: Catalogue, n: int = 50, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Persons with the fewest identifiers."""
    return kpis.party_missing_ids_artist_samples(cat, seed=seed, n=n).select(
        "artist_name", "artist_gid", "ipi_status", "isni_status", "id_completeness_score"
    )


def inconsistency_list(cat: Catalogue) -> DataFrame:
    return kpis.work_recording_inconsistencies(cat).drop("calculated_at")


def recordings_without_isrc(
    cat: Catalogue, n: int = 20, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Recordings that lack an ISRC, ``n`` chosen from all of them."""
    rows = kpis.kpi_isrc_coverage_samples(cat, seed=seed, n=n, kinds=kpis.ISRC_GAPS[:1])
    return rows.select("recording_name", "artist_name", "recording_gid")


def sampled_recordings_without_isrc(
    cat: Catalogue, n: int = 20, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Those of the coverage samples that lack an ISRC, at most ``n``."""
    return (
        kpis.kpi_isrc_coverage_samples(cat, seed=seed)
        .filter(F.col("sample_type") == kpis.ISRC_GAPS[0])
        .orderBy(F.asc_nulls_last("recording_gid"), F.asc_nulls_last("artist_gid"))
        .limit(n)
        .select("recording_name", "artist_name", "recording_gid")
    )


def works_without_iswc(cat: Catalogue, n: int = 20, seed: int = DEFAULT_SEED) -> DataFrame:
    """Works that lack an ISWC, ``n`` chosen from all of them."""
    rows = kpis.kpi_iswc_coverage_samples(cat, seed=seed, n=n, kinds=kpis.ISWC_GAPS[:1])
    return rows.select("work_name", "work_type", "language_code", "work_gid")


def sampled_works_without_iswc(
    cat: Catalogue, n: int = 20, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Those of the coverage samples that lack an ISWC, at most ``n``."""
    return (
        kpis.kpi_iswc_coverage_samples(cat, seed=seed)
        .filter(F.col("sample_type") == kpis.ISWC_GAPS[0])
        .orderBy(F.asc_nulls_last("work_gid"))
        .limit(n)
        .select("work_name", "work_type", "language_code", "work_gid")
    )


# The report's column names.
LEVEL_COLUMNS = [
    "artist_name",
    "artist_gid",
    "phase2_confidence_score",
    "phase2_confidence_level",
    "has_isrc",
    "has_iswc",
    "on_release",
    "has_artist_id",
]


def _towards(level: str) -> Column:
    """Low levels list their lowest scores first, the others their highest."""
    score = F.col("phase2_confidence_score")
    return score.asc() if level == "Low" else score.desc()


def sampled_artists_at_level(
    cat: Catalogue, level: str, n: int = 20, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Artists of a level among the confidence samples, at most ``n``."""
    return (
        kpis.confidence_artist_samples(cat, seed=seed)
        .filter(F.col("phase2_confidence_level") == level)
        .orderBy(_towards(level), F.asc_nulls_last("artist_gid"))
        .limit(n)
        .select(*LEVEL_COLUMNS)
    )


def artists_at_level(
    cat: Catalogue, level: str, n: int = 20, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Artists of a level, at most ``n``, chosen from the whole population."""
    at_level = kpis.confidence_scored("artist", cat).filter(
        F.col("phase2_confidence_level") == level
    )
    order = [_towards(level)]
    chosen = seeded_top_k(at_level, order, ["id"], n, seed)
    described = attach(chosen, n, cat["artist"], "id")
    return (
        seeded_top_k(described, order, ["id"], n, seed)
        .withColumnsRenamed({"name": "artist_name", "gid": "artist_gid"})
        .select(*LEVEL_COLUMNS)
    )


# --- confidence -------------------------------------------------------------------


def confidence_levels(cat: Catalogue, recordings: DataFrame | None = None) -> DataFrame:
    """One row per entity kind: both phases' percentages, the mean and the overall level.

    All four rest on the same recording facts, so those are built and written once.
    """
    facts = shared_facts(cat) if recordings is None else recordings

    def row(label: str, entity: str) -> DataFrame:
        levels = [f"{p}_{level}" for p in ("phase1", "phase2") for level in ("high", "medium", "low")]
        return kpis.confidence_summary(entity, cat, recordings=facts).select(
            F.lit(label).alias("entity_type"),
            *[F.col(f"{level}_pct").alias(f"{level}_percentage") for level in levels],
            "average_phase2_score",
            "overall_confidence_level",
        )

    return _union([row(label, entity) for label, entity in ENTITIES.items()])


def phase_comparison(cat: Catalogue, entity: str = "artist") -> DataFrame:
    """Two rows, one per phase: counts and percentages of each level."""

    def phase(label: str, which: str) -> Column:
        names = [f"{level}_{kind}" for kind in ("count", "pct") for level in ("high", "medium", "low")]
        return F.struct(
            F.lit(label).alias("phase"), *[F.col(f"{which}_{n}").alias(n) for n in names]
        )

    rows = F.array(phase("Phase 1", "phase1"), phase("Phase 2", "phase2"))
    return kpis.confidence_summary(entity, cat).select(F.inline(rows))


def score_histogram(scored: DataFrame) -> DataFrame:
    """Entities per score bin; ``scored`` is any frame with a phase2_confidence_score."""
    score = F.col("phase2_confidence_score")
    bins = reduce(
        lambda acc, item: acc.when(score >= F.lit(item[0]).cast("decimal(2,1)"), item[1]),
        SCORE_BINS.items(),
        F.when(F.lit(False), LOWEST_BIN),
    ).otherwise(LOWEST_BIN)
    return scored.groupBy(bins.alias("score_range")).agg(F.count(F.lit(1)).alias("count"))


def level_cross_tab(scored: DataFrame) -> DataFrame:
    """Phase 1 level by phase 2 level: entities and their mean score."""
    return (
        scored.groupBy("phase1_confidence_level", "phase2_confidence_level")
        .agg(
            F.count(F.lit(1)).alias("count"),
            F.expr(f"sum({milli('phase2_confidence_score')})").alias("milli"),
        )
        .select(
            "phase1_confidence_level",
            "phase2_confidence_level",
            "count",
            mean_milli("milli", "count").alias("avg_score"),
        )
    )


def flag_discrimination(scored: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Per flag: entities that have it, and the mean score with and without it."""
    score = milli("phase2_confidence_score")
    sums = scored.selectExpr(
        "count(*) as n",
        f"sum({score}) as milli",
        *[f"count_if({f} = 1) as {f}_n" for f in flags],
        *[f"sum(case when {f} = 1 then {score} else 0 end) as {f}_milli" for f in flags],
    )

    def row(flag: str) -> Column:
        n, m = f"{flag}_n", f"{flag}_milli"
        return F.struct(
            F.lit(flag).alias("criterion"),
            F.col(n).alias("total_with_criterion"),
            mean_milli(m, n).alias("avg_score_with"),
            mean_milli(f"milli - {m}", f"n - {n}").alias("avg_score_without"),
        )

    return sums.select(F.inline(F.array(*[row(f) for f in flags])))


# --- pivots -----------------------------------------------------------------------


def duplicate_risk_pivot(cat: Catalogue) -> DataFrame:
    """Risk level and name similarity by credit similarity: groups and mean risk."""
    cells = (
        kpis.dup_isrc_unordered(cat)
        .groupBy("risk_level", "name_similarity")
        .pivot("artist_similarity", list(CREDIT_SIMILARITIES))
        .agg(F.count(F.lit(1)).alias("count"), F.sum("duplicate_risk_score").alias("sum"))
    )
    columns = []
    for label, short in CREDIT_SIMILARITIES.items():
        count = f"coalesce(`{label}_count`, 0)"
        columns += [
            F.expr(count).alias(f"count_{short}"),
            pct(f"`{label}_sum`", f"({count} * 100)").alias(f"avg_risk_{short}"),
        ]
    return cells.select("risk_level", "name_similarity", *columns)


def identifier_pivot(labelled: DataFrame) -> DataFrame:
    """IPI status by ISNI status: artists and their mean completeness."""
    return (
        labelled.groupBy("ipi_status", "isni_status")
        .agg(
            F.count(F.lit(1)).alias("artist_count"),
            F.sum("id_completeness_score").alias("score"),
        )
        .select(
            "ipi_status",
            "isni_status",
            "artist_count",
            pct("score", "(artist_count * 100)").alias("avg_completeness"),
        )
    )


def labelled_artists(cat: Catalogue) -> DataFrame:
    """Every settled person lacking an identifier, with status labels and score."""
    return kpis.artists_with_gaps(cat).select(
        "id", *presence_labels(kpis.IDENTIFIERS), "id_completeness_score"
    )


def confidence_pivot(cat: Catalogue, recordings: DataFrame | None = None) -> DataFrame:
    """Entity kind by overall level: mean score and mean share of phase 1 High."""
    return (
        confidence_levels(cat, recordings)
        .groupBy("entity_type", "overall_confidence_level")
        .agg(
            F.avg("average_phase2_score").alias("avg_score"),
            F.avg("phase1_high_percentage").alias("avg_phase1_high_pct"),
        )
    )


# --- whole lists of linked names ---------------------------------------------------

#: Names to a row of the listings below.
LISTED = 20


def work_recording_names(cat: Catalogue, page: int = LISTED) -> DataFrame:
    """Every settled work's recordings by name, ``page`` to a row."""
    links = cat["l_recording_work"].select("entity0", F.col("entity1").alias("work_id"))
    settled_works = settled(cat["work"]).select(F.col("id").alias("work_id"))
    named = cat["recording"].select(F.col("id").alias("entity0"), "name")
    names = links.join(settled_works, "work_id", "left_semi").join(named, "entity0").select("work_id", "name")
    return name_pages(names, "work_id", "name", page)


def credit_recording_names(cat: Catalogue, page: int = LISTED) -> DataFrame:
    """Every credit's settled recordings by name, ``page`` to a row."""
    names = settled(cat["recording"]).where("artist_credit is not null").select("artist_credit", "name")
    return name_pages(names, "artist_credit", "name", page)
