"""Published figures kept up to date load by load.

A load is a part of the catalogue: any rows of any of its tables.  Adding one reads that load
alone and writes its state: sets of ids as bitmaps, the entities of each code as bitmaps,
the URLs of artists, and a bottom-k sketch of each entity table: the rows whose seeded hashes
come first, which are all that a sample of the whole can take from that load.  The rows of
its tables are counted along with it, so counts and the checks on them scan nothing later.  States are merged when figures are read, and merging is uniting, so
figures do not depend on the order of loads or on which load a row came with; a link may
come before the row it points to, and a row that comes twice counts once.  Figures equal
those over all loads read at once.  Rows are only ever added: what a later load says of an
id is united with what earlier ones said.

A load counts from the moment its name is committed, so a run that dies halfway may be run
again, and a load added twice is there once.  ``compact`` folds all states into one.

The overview, both code coverages and the identifiers of persons are kept this way.  The
confidence views follow links over several tables, which a load by itself does not hold.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalens.functions.sampling import DEFAULT_SEED, random_sample, seeded_top_k
from catalens.operators import bitmaps
from catalens.operators.coverage import coverage_row
from catalens.operators.identifiers import presence_row
from catalens.operators.overview import overview_row
from catalens.plans.checks import EXPECTED_RECORDINGS, counted_rows, load_checks
from catalens.plans.flags import persons, settled
from catalens.plans.kpis import IDENTIFIERS, SCOPE_COVERAGE, URL_IDENTIFIERS, AsOf, _stamp
from catalens.sources.catalogue import Catalogue, conform
from catalens.sources.contract import CONTRACT
from catalens.sources.keyed import Files

#: Label of the overview -> entity.
LABELS = {"Artists": "artist", "Works": "work", "Recordings": "recording", "Releases": "release"}
#: Code -> its link column and the word for its entities.
CODES = {"isrc": ("recording", "recordings"), "iswc": ("work", "works")}
LOADS = "_loads"
PARTS = ("sets", "codes", "links")
#: Tables that samples are taken from, the rows of each load that a sample can take, and the
#: seed of their order.
SAMPLED = ("artist", "work", "recording", "release")
SAMPLE_ROWS = 1000
SAMPLE_SEED = DEFAULT_SEED


def _sets(cat: Catalogue) -> dict[str, tuple[DataFrame, str]]:
    """Set name -> rows and the column whose ids belong to it."""
    everyone = {"artist": persons(cat["artist"])} | {e: cat[e] for e in ("work", "recording", "release")}
    found = {f"{e}.all": (rows, "id") for e, rows in everyone.items()}
    found |= {f"{e}.gid": (rows.where("gid is not null"), "id") for e, rows in everyone.items()}
    found |= {f"{e}.member": (settled(everyone[e]), "id") for e in ("artist", "work", "recording")}
    found |= {f"{key}.{code}": (cat[code], key) for code, (key, _) in CODES.items()}
    found |= {"artist.ipi": (cat["artist_ipi"], "artist"), "artist.isni": (cat["artist_isni"], "artist")}
    urls = cat["url"].where("url is not null")
    return found | {f"url.{name}": (urls.where(F.contains("url", F.lit(name))), "id") for name in URL_IDENTIFIERS}


def _bits(rows: DataFrame, column: str, *keys) -> DataFrame:
    key = F.col(column).cast("bigint")
    return rows.where(key.isNotNull()).select(*keys, bitmaps.word_of(key).alias(bitmaps.WORD), bitmaps.bit_of(key).alias("bits"))


def _united(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, bitmaps.WORD).agg(F.bit_or("bits").alias("bits"))


class PublishedState:
    """The state of all loads under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), Files(spark, path)

    # --- loads -----------------------------------------------------------------

    def loads(self) -> list[str]:
        return sorted(name for entry in self._entries().values() for name in entry["loads"])

    def _entries(self) -> dict[str, dict]:
        """Committed states by file, without those that a later one folded."""
        names = [n for n in self._files.names(LOADS) if n.endswith(".json")]
        entries = {n: json.loads(self._files.read(f"{LOADS}/{n}")) for n in names}
        folded = {n for entry in entries.values() for n in entry["replaces"]}
        return {n: entry for n, entry in entries.items() if n not in folded}

    def add(self, name: str, cat: Catalogue) -> bool:
        """Add a load; False if a load of that name is there already."""
        if name in self.loads():
            return False
        folder = f"state/{uuid.uuid4().hex}"
        sets = reduce(DataFrame.unionByName, [_bits(rows, column, F.lit(s).alias("name")) for s, (rows, column) in _sets(cat).items()])
        _united(sets, "name").write.parquet(f"{self.path}/{folder}/sets")
        codes = [
            _bits(cat[code].where(f"{code} is not null"), key, F.lit(code).alias("kind"), F.col(code).alias("code")) for code, (key, _) in CODES.items()
        ]
        _united(reduce(DataFrame.unionByName, codes), "kind", "code").write.parquet(f"{self.path}/{folder}/codes")
        links = _bits(cat["l_artist_url"].where("entity1 is not null"), "entity0", F.col("entity1").alias("url"))
        _united(links, "url").write.parquet(f"{self.path}/{folder}/links")
        for table in SAMPLED:
            bottom = seeded_top_k(conform(cat[table], table), [], ["id"], SAMPLE_ROWS, SAMPLE_SEED)
            bottom.write.parquet(f"{self.path}/{folder}/samples/{table}")
        counts = counted_rows(cat, CONTRACT)
        counts.write.parquet(f"{self.path}/{folder}/counts")
        # The name is the lock: of two writers of one load one commits.
        return self._files.create(f"{LOADS}/{name}.json", json.dumps({"folder": folder, "loads": [name], "replaces": []}))

    def compact(self) -> None:
        """Fold all states into one; loads added meanwhile stay beside it."""
        entries = self._entries()
        if len(entries) < 2:
            return
        folder = f"state/{uuid.uuid4().hex}"
        for part in PARTS:
            self._part(part, entries).write.parquet(f"{self.path}/{folder}/{part}")
        for table in SAMPLED:
            self._bottom(table, entries, SAMPLE_ROWS).write.parquet(f"{self.path}/{folder}/samples/{table}")
        self._counts(entries).write.parquet(f"{self.path}/{folder}/counts")
        loads = sorted(name for entry in entries.values() for name in entry["loads"])
        self._files.create(f"{LOADS}/folded-{uuid.uuid4().hex}.json", json.dumps({"folder": folder, "loads": loads, "replaces": list(entries)}))

    def _part(self, part: str, entries: dict[str, dict] | None = None) -> DataFrame:
        """One part of the state, united over all loads."""
        keys = {"sets": ["name"], "codes": ["kind", "code"], "links": ["url"]}[part]
        paths = [f"{self.path}/{e['folder']}/{part}" for e in (self._entries() if entries is None else entries).values()]
        kinds = {"url": "bigint"}
        schema = ", ".join([*(f"{k} {kinds.get(k, 'string')}" for k in keys), f"{bitmaps.WORD} bigint", "bits bigint"])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows if len(paths) == 1 else _united(rows, *keys)

    def _bottom(self, table: str, entries: dict[str, dict], n: int) -> DataFrame:
        """The first ``n`` rows of a table's order over all loads, each id once.

        At most ``SAMPLE_ROWS`` rows of each load are read, whatever the tables hold.
        """
        paths = [f"{self.path}/{e['folder']}/samples/{table}" for e in entries.values()]
        if not paths:
            return self.spark.createDataFrame([], CONTRACT[table])
        rows = self.spark.read.schema(CONTRACT[table]).parquet(*paths)
        whole = F.struct(*rows.columns)
        once = rows.groupBy("id").agg(F.max(whole).alias("row")).select("row.*")
        return seeded_top_k(once, [], ["id"], n, SAMPLE_SEED)

    def sample(self, table: str, n: int = 10) -> DataFrame:
        """``random_sample`` of a table over all loads, from the sketches alone."""
        if table not in SAMPLED or n > SAMPLE_ROWS:
            raise ValueError(f"samples are kept of {SAMPLED}, {SAMPLE_ROWS} rows at most")
        return random_sample(self._bottom(table, self._entries(), n), n, SAMPLE_SEED, ["id"])

    def _counts(self, entries: dict[str, dict]) -> DataFrame:
        """Rows of all loads, as ``counted_rows`` names them."""
        paths = [f"{self.path}/{e['folder']}/counts" for e in entries.values()]
        schema = "name string, rows bigint"
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy("name").agg(F.sum("rows").alias("rows"))

    def table_row_counts(self) -> DataFrame:
        """table_name, row_count over all loads."""
        counts = self._counts(self._entries()).where(F.col("name").isin(*CONTRACT))
        return counts.select(F.col("name").alias("table_name"), F.col("rows").alias("row_count"))

    def load_checks(self, expected: int = EXPECTED_RECORDINGS) -> DataFrame:
        """The checks that look at counts alone, over all loads."""
        return load_checks(self._counts(self._entries()), expected)

    # --- figures ---------------------------------------------------------------

    def _words(self, *names: str) -> DataFrame:
        """(_word, a column of bits per set)."""
        rows = self._part("sets").where(F.col("name").isin(*names))
        zero = F.lit(0).cast("bigint")
        return rows.groupBy(bitmaps.WORD).agg(
            *[F.coalesce(F.bit_or(F.when(F.col("name") == n, F.col("bits"))), zero).alias(n.split(".")[1]) for n in names]
        )

    def stats_overview(self) -> DataFrame:
        def row(label: str, entity: str) -> DataFrame:
            words = self._words(f"{entity}.all", f"{entity}.gid")
            counts = words.agg(bitmaps.size(F.col("all")).alias("total_count"), bitmaps.size(F.col("gid")).alias("with_gid"))
            return overview_row(counts, label, "gid")

        return reduce(DataFrame.unionByName, [row(*item) for item in LABELS.items()])

    def coverage(self, code: str, as_of: AsOf = None) -> DataFrame:
        """The coverage KPI of a code."""
        entity, entities = CODES[code]
        words = self._words(f"{entity}.member", f"{entity}.{code}")
        member, linked = F.col("member"), F.col(code)
        covered = words.agg(bitmaps.size(member).alias("total"), bitmaps.size(member.bitwiseAND(linked)).alias("coded"))
        held = self._part("codes").where(F.col("kind") == code).join(words.select(bitmaps.WORD, "member"), bitmaps.WORD)
        per_code = held.groupBy("code").agg(bitmaps.size(F.col("bits").bitwiseAND(member)).alias("n")).where("n > 0")
        counted = per_code.selectExpr("count(*) as codes", "count_if(n > 1) as shared", "coalesce(sum(case when n > 1 then n end), 0L) as sharing")
        zero = F.lit(0).cast("bigint")
        columns = ["total", "coded", "codes", "shared", "sharing"]
        rows = [df.select(*[F.col(c) if c in df.columns else zero.alias(c) for c in columns]) for df in (covered, counted)]
        one_row = rows[0].unionByName(rows[1]).groupBy().sum().toDF(*columns)
        return coverage_row(one_row, code, entities).select("*", *_stamp(as_of, SCOPE_COVERAGE))

    def kpi_isrc_coverage(self, as_of: AsOf = None) -> DataFrame:
        return self.coverage("isrc", as_of)

    def kpi_iswc_coverage(self, as_of: AsOf = None) -> DataFrame:
        return self.coverage("iswc", as_of)

    def party_missing_ids_artist_distinct(self, as_of: AsOf = None) -> DataFrame:
        """Identifiers of settled persons, each person once."""
        urls = self._words(*[f"url.{name}" for name in URL_IDENTIFIERS])
        url = F.col("url")
        named = [F.col(n).bitwiseAND(bitmaps.bit_of(url)) != 0 for n in URL_IDENTIFIERS]
        links = self._part("links").withColumnRenamed(bitmaps.WORD, "_artists")
        met = links.join(urls, bitmaps.word_of(url) == F.col(bitmaps.WORD))
        zero = F.lit(0).cast("bigint")
        by_url = met.groupBy(F.col("_artists").alias(bitmaps.WORD)).agg(
            *[F.bit_or(F.when(has, F.col("bits")).otherwise(zero)).alias(n) for n, has in zip(URL_IDENTIFIERS, named)]
        )
        own = self._words("artist.member", "artist.ipi", "artist.isni")
        words = own.join(by_url, bitmaps.WORD, "left")
        member = F.col("member")
        sums = words.agg(
            bitmaps.size(member).alias("total"),
            *[bitmaps.size(member.bitwiseAND(F.coalesce(n, zero))).alias(n) for n in IDENTIFIERS],
        )
        return presence_row(sums, list(IDENTIFIERS), "artists").select("*", *_stamp(as_of, SCOPE_COVERAGE))

    def register(self, as_of: AsOf = None) -> list[str]:
        """Publish the figures as temporary views of their KPIs' names."""
        views = {
            "stats_overview": self.stats_overview(),
            "kpi_isrc_coverage": self.kpi_isrc_coverage(as_of),
            "kpi_iswc_coverage": self.kpi_iswc_coverage(as_of),
            "party_missing_ids_artist_distinct": self.party_missing_ids_artist_distinct(as_of),
        }
        for name, view in views.items():
            view.createOrReplaceTempView(name)
        return list(views)
