from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalens.session import tune
from catalens.sources.contract import CONTRACT


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("catalens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def make_catalogue(spark):
    """A catalogue of the given rows; tables not named are empty.

    Rows are dicts; columns they leave out are NULL, but edits_pending is 0.
    """

    def build(**tables):
        frames = {}
        for name, schema in CONTRACT.items():
            default = {"edits_pending": 0} if "edits_pending" in schema.names else {}
            rows = [
                tuple({**default, **row}.get(c) for c in schema.names)
                for row in tables.get(name, [])
            ]
            frames[name] = spark.createDataFrame(rows, schema)
        unknown = set(tables) - set(CONTRACT)
        assert not unknown, unknown
        return frames

    return build
