"""Running the oracle SQL in DuckDB and comparing it with Spark rows.

Test modules import helpers from here, never from ``conftest``: each folder has a file of
that name, and only one of them can be the module ``conftest``.
"""

from __future__ import annotations

import glob
import os

import duckdb


def over_parquet(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{directory}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {view} as select * from '{path}'")
    return con


def fetch(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    return sorted(columns), sorted(rows, key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    rows = [tuple(row[c] for c in columns) for row in df.collect()]
    return columns, sorted(rows, key=repr)


def assert_same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns, expected = fetch(con, sql)
    actual_columns, actual = spark_rows(df)
    assert actual_columns == columns
    assert actual == expected


def rows_of(df) -> list[dict]:
    return [row.asDict(recursive=True) for row in df.collect()]
