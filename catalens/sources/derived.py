"""A catalogue derived from the star-schema test tables.

The rules are those of FIXTURES.md.  Where a rule there is a UNION ALL of several
filters over one table, this reads the table once and unfolds an array of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.sources.catalogue import conform, require_columns

Read = Callable[[str], DataFrame]

# The columns the rules below use, and their types.
SOURCES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int",
}

# Recordings take their titles from the parts with these keys: 0 .. TITLES - 1.
TITLES = 50


def _unfold(df: DataFrame, *cases: tuple[str, str]) -> DataFrame:
    """Per row of ``df``, one output row for every (condition, struct) whose condition holds.

    The first field of every struct is a key and never NULL, unlike that of a skipped case.
    """
    rows = ", ".join(f"case when {cond} then named_struct({fields}) end" for cond, fields in cases)
    unfolded = df.selectExpr(f"inline(array({rows}))")
    return unfolded.where(f"{unfolded.columns[0]} is not null")


def _url(read: Read) -> DataFrame:
    return _unfold(
        read("customer"),
        (
            "c_custkey % 4 = 0",
            "'id', c_custkey * 4, 'url', concat('https://viaf.org/viaf/', c_custkey)",
        ),
        (
            "c_custkey % 2 = 0",
            "'id', c_custkey * 4 + 1, 'url', concat('https://www.wikidata.org/wiki/Q', c_custkey)",
        ),
        (
            "c_custkey % 7 = 0",
            "'id', c_custkey * 4 + 2, 'url', concat('https://www.imdb.com/name/nm', c_custkey)",
        ),
        (
            "c_custkey % 9 = 0",
            "'id', c_custkey * 4 + 3, 'url', concat('https://example.org/a/', c_custkey)",
        ),
    )


def _titled_orders(read: Read) -> DataFrame:
    # p_partkey is unique, so at most TITLES rows are broadcast whatever the scale.
    titles = F.broadcast(
        read("part").where(f"p_partkey between 0 and {TITLES - 1}").select("p_partkey", "p_name")
    )
    return read("orders").join(titles, F.expr(f"p_partkey = (o_orderkey div 4) % {TITLES}"))


RULES: dict[str, Callable[[Read], DataFrame]] = {
    "artist": lambda read: read("customer").selectExpr(
        "c_custkey as id",
        "md5(concat('artist:', c_custkey)) as gid",
        "c_name as name",
        "c_name as sort_name",
        "case when c_mktsegment in ('BUILDING', 'HOUSEHOLD', 'FURNITURE') then 1 else 2 end"
        " as type",
        "c_nationkey as area",
        "cast(1900 + c_custkey % 100 as int) as begin_date_year",
        "cast(null as int) as end_date_year",
        "case when c_custkey % 23 = 0 then 1 else 0 end as edits_pending",
    ),
    "artist_ipi": lambda read: _unfold(
        read("customer"),
        (
            "c_custkey % 3 = 1",
            "'artist', c_custkey, 'ipi', lpad(cast(c_custkey * 10 as string), 11, '0')",
        ),
        (
            "c_custkey % 6 = 1",
            "'artist', c_custkey, 'ipi', lpad(cast(c_custkey * 10 + 1 as string), 11, '0')",
        ),
    ),
    "artist_isni": lambda read: read("customer").filter("c_custkey % 7 = 3").selectExpr(
        "c_custkey as artist", "lpad(cast(c_custkey * 10 as string), 16, '0') as isni"
    ),
    "url": _url,
    "l_artist_url": lambda read: _url(read).selectExpr("id div 4 as entity0", "id as entity1"),
    "artist_credit": lambda read: read("customer").selectExpr("c_custkey as id", "c_name as name"),
    "artist_credit_name": lambda read: _unfold(
        read("customer"),
        ("true", "'artist_credit', c_custkey, 'position', 0, 'artist', c_custkey"),
        (
            "c_custkey % 8 = 0",
            "'artist_credit', c_custkey, 'position', 1, 'artist', c_custkey + 1",
        ),
    ),
    "recording": lambda read: _titled_orders(read).selectExpr(
        "o_orderkey as id",
        "md5(concat('recording:', o_orderkey)) as gid",
        "case when o_orderkey % 60 = 3 then 'other title'"
        " when o_orderkey % 40 = 23 then concat(p_name, ' (Live)')"
        " when o_orderkey % 80 = 3 then upper(p_name) else p_name end as name",
        "case when o_orderkey % 12 in (2, 3, 6, 7) then (o_orderkey div 4) % 37 * 4"
        " else o_custkey - o_custkey % 4 end as artist_credit",
        "case when o_orderkey % 11 = 0 then null"
        " when o_orderkey % 16 < 12 then 180000 + o_orderkey % 7 * 900"
        " else cast(floor(o_totalprice) as bigint) end as length",
        "case when o_orderpriority = '1-URGENT' then 'live' else '' end as comment",
        "case when o_orderkey % 50 = 0 then 1 else 0 end as edits_pending",
        "o_orderdate as last_updated",
    ),
    "isrc": lambda read: _unfold(
        read("orders"),
        (
            "o_orderkey % 20 in (2, 3)",
            "'recording', o_orderkey,"
            " 'isrc', concat('QZ', lpad(cast(o_orderkey div 2 as string), 10, '0'))",
        ),
        (
            "o_orderkey % 30 in (9, 10, 11)",
            "'recording', o_orderkey,"
            " 'isrc', concat('QX', lpad(cast(o_orderkey div 3 as string), 10, '0'))",
        ),
        (
            "o_orderkey % 5 = 4",
            "'recording', o_orderkey,"
            " 'isrc', concat('QU', lpad(cast(o_orderkey as string), 10, '0'))",
        ),
    ),
    "work": lambda read: read("part").selectExpr(
        "p_partkey as id",
        "md5(concat('work:', p_partkey)) as gid",
        "p_name as name",
        "p_size as type",
        "'' as comment",
        "case when p_partkey % 40 = 0 then 1 else 0 end as edits_pending",
        "timestamp_ntz '2024-01-01 00:00:00' as last_updated",
    ),
    "iswc": lambda read: _unfold(
        read("part"),
        (
            "p_partkey % 3 = 1",
            "'work', p_partkey,"
            " 'iswc', concat('T', lpad(cast(p_partkey as string), 9, '0'))",
        ),
        (
            "p_partkey % 10 in (4, 5)",
            "'work', p_partkey,"
            " 'iswc', concat('U', lpad(cast(p_partkey div 2 as string), 9, '0'))",
        ),
    ),
    "l_recording_work": lambda read: read("lineitem").filter("l_linenumber = 1 and l_partkey % 7 <> 0")
    .selectExpr("l_orderkey as entity0", "l_partkey as entity1")
    .distinct(),
    "release_group": lambda read: read("supplier").selectExpr(
        "s_suppkey as id",
        "s_name as name",
        "case when s_suppkey % 8 = 0 then null else s_nationkey end as type",
    ),
    "release": lambda read: read("part").selectExpr(
        "p_partkey as id",
        "md5(concat('release:', p_partkey)) as gid",
        "concat(p_name, ' ', p_brand) as name",
        "p_partkey % 100 as release_group",
        "case when p_size % 6 = 0 then null else 1 end as status",
        "case when p_partkey % 60 = 0 then 1 else 0 end as edits_pending",
    ),
    "medium": lambda read: _unfold(
        read("part"),
        ("true", "'id', p_partkey * 2, 'release', p_partkey"),
        ("p_partkey % 3 = 0", "'id', p_partkey * 2 + 1, 'release', p_partkey"),
    ),
    "track": lambda read: read("lineitem").filter("l_linenumber >= 6").selectExpr(
        "l_orderkey * 1000000 + l_partkey as id",
        "l_partkey * 2 + case when l_partkey % 3 = 0 then l_linenumber % 2 else 0 end"
        " as medium",
        "l_orderkey as recording",
    ),
}


class DerivedCatalogue(Mapping[str, DataFrame]):
    """The catalogue tables over one folder of test tables, each set up on first use."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self._spark, self.directory = spark, directory
        self._sources: dict[str, DataFrame] = {}
        self._tables: dict[str, DataFrame] = {}

    def _read(self, source: str) -> DataFrame:
        if source not in self._sources:
            path = f"{self.directory}/{source}.parquet"
            wanted = T.StructType.fromDDL(SOURCES[source])
            rows = require_columns(self._spark.read.parquet(path), source, wanted.names)
            self._sources[source] = rows.select(
                *[
                    F.col(f.name) if rows.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType)
                    for f in wanted.fields
                ]
            )
        return self._sources[source]

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._tables:
            self._tables[table] = conform(RULES[table](self._read), table)
        return self._tables[table]

    def __iter__(self) -> Iterator[str]:
        return iter(RULES)

    def __len__(self) -> int:
        return len(RULES)
