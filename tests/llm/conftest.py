from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(__file__))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text[, lang[, source]]) rows, with columns whose
    names an operator might be using itself."""

    def build(rows, clash=True):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for name in ("fp", "root", "draw", "copies", "target", "_id", "n", "spans", "score", "key"):
                df = df.withColumn(name, F.lit(name))
        return df

    return build


@pytest.fixture
def table_dir(tmp_path):
    """A folder of tables as the queries read them."""

    def build(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return build


@pytest.fixture
def schema_of():
    return T.StructType.fromDDL
