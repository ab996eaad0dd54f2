"""Data checks: one row each, with a status and the value it was judged on."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalens.plans import kpis
from catalens.plans.flags import coded_rows, shared_facts
from catalens.plans.reports import ENTITIES
from catalens.sources.catalogue import Catalogue

# Fewer recordings than this suggest an incomplete load.
EXPECTED_RECORDINGS = 1_000_000


def _verdict(good: Column) -> Column:
    return F.when(good, "ok").otherwise("fail")


def _row(check: str, status: Column, value: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"), status.alias("status"), value.cast("double").alias("value")
    )


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.inline(F.array(*rows)))


#: Count -> the check that there is something to count.
SOMETHING = {
    "isrc.isrc": "some recording has an ISRC",
    "iswc.iswc": "some work has an ISWC",
    "artist ids": "some artist has an ISNI or IPI",
}


def counted_rows(cat: Catalogue, tables: Iterable[str] = ()) -> DataFrame:
    """(name, rows): the rows of each of ``tables`` and those that the checks look at.

    Counts of parts of a catalogue add up to those of the whole.
    """
    ids = cat["artist_isni"].select("artist").union(cat["artist_ipi"].select("artist"))
    rows = {"isrc.isrc": coded_rows(cat, "isrc"), "iswc.iswc": coded_rows(cat, "iswc"), "artist ids": ids}
    rows |= {"recording": cat["recording"]} | {t: cat[t] for t in tables}
    frames = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in rows.items()]
    return reduce(DataFrame.unionByName, frames)


def load_checks(counts: DataFrame, expected: int = EXPECTED_RECORDINGS) -> DataFrame:
    """check, status, value of what ``counted_rows`` found: something of each kind, and a load of
    the volume expected."""
    n = F.col("rows")
    some = F.create_map(*[F.lit(x) for pair in SOMETHING.items() for x in pair])
    volume = F.when(n == 0, "fail").when(n < expected, "warn").otherwise("ok")
    loaded = F.col("name") == "recording"
    checked = counts.where(loaded | F.col("name").isin(*SOMETHING))
    return checked.select(
        F.when(loaded, "recordings loaded").otherwise(some[F.col("name")]).alias("check"),
        F.when(loaded, volume).otherwise(_verdict(n > 0)).alias("status"),
        n.cast("double").alias("value"),
    )


def _confidence(label: str, entity: str, cat: Catalogue, facts: DataFrame) -> DataFrame:
    total = F.col(f"total_{kpis.CONFIDENCE[entity].entities}")
    mean = F.col("average_phase2_score")

    def levels(phase: str) -> Column:
        return sum((F.col(f"{phase}_{lv}_count") for lv in ("high", "medium", "low")), F.lit(0))

    return _rows(
        kpis.confidence_summary(entity, cat, recordings=facts),
        _row(f"{label}: population not empty", _verdict(total > 0), total),
        *[
            _row(f"{label}: {p} counts sum to total", _verdict(levels(p) == total), levels(p))
            for p in ("phase1", "phase2")
        ],
        _row(f"{label}: average score in [0, 1]", _verdict(mean.between(0, 1)), mean),
    )


def data_checks(
    cat: Catalogue,
    expected_recordings: int = EXPECTED_RECORDINGS,
    recordings: DataFrame | None = None,
) -> DataFrame:
    """check, status (ok, warn or fail), value."""
    facts = shared_facts(cat) if recordings is None else recordings
    frames = [
        load_checks(counted_rows(cat), expected_recordings),
        *[_confidence(label, entity, cat, facts) for label, entity in ENTITIES.items()],
    ]
    return reduce(DataFrame.unionByName, frames)


def key_checks(report: DataFrame, referred: Iterable[str]) -> DataFrame:
    """check, status, value of each key column of a ``key_report``.

    An id that repeats multiplies the rows of whatever joins it, so it fails where another
    table refers to it (``referred``); elsewhere it is a warning, as is a missing row.
    """
    column = F.concat("table_name", F.lit("."), "column_name")
    broken = F.col("repeated_rows") + F.col("null_rows")
    own = (F.col("table_name") == F.col("refers_to")) & (F.col("column_name") == "id")
    repeats = F.when(broken == 0, "ok").when(F.col("table_name").isin(*referred), "fail").otherwise("warn")
    unique = F.struct(F.concat(column, F.lit(" holds each id once")).alias("check"), repeats.alias("status"), broken.cast("double").alias("value"))
    lost = F.col("missing_ids")
    there = F.struct(
        F.concat(column, F.lit(" refers to rows of "), "refers_to").alias("check"),
        F.when(lost == 0, "ok").otherwise("warn").alias("status"),
        lost.cast("double").alias("value"),
    )
    return report.select(F.when(own, unique).otherwise(there).alias("c")).select("c.*")
