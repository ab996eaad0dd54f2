"""Publishing all KPIs over a catalogue: load, share, register, check, record."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.plans.checks import EXPECTED_RECORDINGS, data_checks, key_checks
from catalens.plans.flags import shared_facts
from catalens.plans.integrity import REFERRED, catalogue_keys
from catalens.plans.kpis import KPIS, register
from catalens.session import tune
from catalens.sources import runlog
from catalens.sources.catalogue import Catalogue, load_catalogue

SCHEMA_VERSION = "1"


@dataclass(frozen=True)
class Published:
    views: list[str]
    #: check -> status, for every data check.
    checks: dict[str, str]

    @property
    def failed(self) -> list[str]:
        return [check for check, status in self.checks.items() if status == "fail"]


def publish(
    spark: SparkSession,
    directory: str,
    log: str,
    as_of: dt.datetime | None = None,
    scope_note: str | None = None,
    expected_recordings: int = EXPECTED_RECORDINGS,
) -> Published:
    """Register every KPI view over the tables under ``directory`` and record the run.

    The catalogue's keys are checked by value along with the figures: an id that repeats and is
    referred to would multiply rows, so it fails; a reference to a row that is not there is a
    warning.  The recording facts behind the confidence views are worked out once and written to the
    shared folder.  Run it again and the views are replaced and the log's keys updated.
    """
    moment = as_of or dt.datetime.now()
    cat = load_catalogue(tune(spark), directory)
    facts = shared_facts(cat)
    views = register(spark, cat, as_of, recordings=facts, scope_note=scope_note)
    rows = key_checks(catalogue_keys(cat), REFERRED).unionByName(data_checks(cat, expected_recordings, recordings=facts)).collect()
    done = Published(views, {r["check"]: r["status"] for r in rows})
    entries = {
        "schema_version": SCHEMA_VERSION,
        "views_applied_at": moment.isoformat(),
        "views": ",".join(done.views),
        "failed_checks": ",".join(done.failed),
    }
    runlog.record_first(spark, log, {"first_applied_at": moment.isoformat()}, moment)
    runlog.record(spark, log, entries, moment)
    return done


def published_views(spark: SparkSession, cat: Catalogue) -> DataFrame:
    """view_name, description and row_count of every view, read through the views."""

    def row(name: str) -> DataFrame:
        counted = spark.table(name).agg(F.count(F.lit(1)).alias("row_count"))
        return counted.select(
            F.lit(name).alias("view_name"),
            F.lit(KPIS[name].description).alias("description"),
            "row_count",
        )

    names = register(spark, cat, recordings=shared_facts(cat))
    return reduce(DataFrame.unionByName, [row(name) for name in names])
