"""The log of runs: one row per key, with its latest value and time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from catalens.sources.contract import RUN_LOG
from catalens.sources.keyed import KeyedTable, Version


def _table(spark: SparkSession, path: str) -> KeyedTable:
    # A handful of keys: one bucket, which each run writes anew.
    return KeyedTable.open_or_create(spark, path, RUN_LOG, "key", buckets=1)


def record(spark: SparkSession, path: str, entries: Mapping[str, str], as_of: dt.datetime) -> Version:
    """Put the values under their keys, all of them or none."""
    rows = spark.createDataFrame([(key, value, as_of) for key, value in entries.items()], RUN_LOG)
    return _table(spark, path).upsert(rows)


def record_first(spark: SparkSession, path: str, entries: Mapping[str, str], as_of: dt.datetime) -> Version:
    """Put the values under those keys that have none yet."""
    rows = spark.createDataFrame([(key, value, as_of) for key, value in entries.items()], RUN_LOG)
    return _table(spark, path).add_missing(rows)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path).read()
