"""Loading the catalogue against its column contract."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from catalens.sources.contract import CONTRACT

Catalogue = Mapping[str, DataFrame]

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


class ContractError(ValueError):
    """A table lacks a column the KPIs need, or holds it in an unusable type."""


def _readable_as(actual: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(wanted, T.IntegralType):
        return isinstance(actual, T.IntegralType)
    if isinstance(wanted, T.TimestampType):
        return isinstance(actual, _TIMES)
    return isinstance(actual, (T.StringType, T.CharType, T.VarcharType))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Exactly the contract's columns of ``table``, in its types; else ContractError.

    Columns that already have their type are passed on as they are, so filters on the
    result still reach the file scan.
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    wanted = CONTRACT[table].fields
    missing = [f.name for f in wanted if f.name not in actual]
    if missing:
        raise ContractError(f"table {table}: missing columns {missing}")
    wrong = [
        f"{f.name} is {actual[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in wanted
        if not _readable_as(actual[f.name], f.dataType)
    ]
    if wrong:
        raise ContractError(f"table {table}: {'; '.join(wrong)}")
    columns = [
        f.name
        if actual[f.name] == f.dataType
        else f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}"
        for f in wanted
    ]
    return df if columns == list(actual) else df.selectExpr(*columns)


def require_columns(df: DataFrame, table: str, names: Iterable[str]) -> DataFrame:
    """``df`` if it has all the columns, else ContractError."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ContractError(f"table {table}: missing columns {missing}")
    return df


def load_catalogue(
    spark: SparkSession,
    directory: str,
    tables: Iterable[str] = tuple(CONTRACT),
    pattern: str = "{table}.parquet",
) -> Catalogue:
    """The catalogue tables under ``directory``, one parquet file or folder each."""
    return {
        table: conform(spark.read.parquet(f"{directory}/{pattern.format(table=table)}"), table)
        for table in tables
    }
