"""Tables with one row per key, committed version by version.

The rows lie in ``buckets`` by a hash of their key, each bucket in a folder of its own.  A
version is a manifest that names the folder of every bucket.  A merge reads the buckets its
updates fall into, writes those anew under a new folder, and commits by renaming a manifest
into place, which fails if that version exists already: of two writers that started from the
same version one wins, and the other starts again from what it left.  Readers of a version
see all of it or none; a writer that dies leaves files that no manifest names.  The folders of
untouched buckets are named again, so a merge costs what it touches and not the table.

Folders are written by Spark's executors and listed by none: the driver handles a manifest,
which has an entry a bucket.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalens.sources.store import upsert_by_key

BUCKET = "_bucket"
VERSIONS = "_versions"
#: How often a merge starts again after another writer was first.
ATTEMPTS = 8


class ConcurrentUpdate(RuntimeError):
    """Another writer committed the version this one was about to commit."""


class DuplicateKey(ValueError):
    """Several updates name one key, and nothing says which of them counts."""


@dataclass(frozen=True)
class Version:
    number: int
    #: bucket -> folder under the table's path.
    folders: dict[int, str]


class Files:
    """The file system of a path, by Hadoop's own interface, as executors see it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._fs = self._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self._store = self._fs.Path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._store.listStatus(path)] if self._store.exists(path) else []

    def read(self, name: str) -> str:
        source = self._store.open(self._path(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def create(self, name: str, text: str) -> bool:
        """A whole new file, or False if there is one of that name."""
        own = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._store.create(own, False)
        out.write(text.encode())
        out.close()
        context = self._fs.FileContext.getFileContext(own.toUri(), self._conf)
        options = self._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(own, self._path(name), options)  # never over an existing file
        except Py4JJavaError as error:
            self._store.delete(own, False)
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            return False
        return True

    def delete(self, name: str) -> None:
        self._store.delete(self._path(name), True)


class KeyedTable:
    """A stored table with one row for each value of ``keys``; NULL keys are keys as well."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._files = spark, path.rstrip("/"), Files(spark, path)
        about = json.loads(self._files.read(f"{VERSIONS}/table.json"))
        self.keys: list[str] = about["keys"]
        self.buckets: int = about["buckets"]
        self.schema = T.StructType.fromJson(about["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: str | Sequence[str], buckets: int = 64) -> KeyedTable:
        """An empty table.  ``buckets`` is fixed: choose it so that a bucket suits one task."""
        keys = [keys] if isinstance(keys, str) else list(keys)
        unknown = [k for k in keys if k not in schema.names]
        if unknown or not keys:
            raise ValueError(f"keys {unknown or keys} are no columns of the table")
        files = Files(spark, path)
        about = {"keys": keys, "buckets": buckets, "schema": schema.jsonValue()}
        if not files.create(f"{VERSIONS}/table.json", json.dumps(about)):
            raise ConcurrentUpdate(f"{path} is a table already")
        files.create(f"{VERSIONS}/{0:010d}.json", "{}")
        return cls(spark, path)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: str | Sequence[str], buckets: int = 64) -> KeyedTable:
        if "table.json" not in Files(spark, path).names(VERSIONS):
            try:
                return cls.create(spark, path, schema, keys, buckets)
            except ConcurrentUpdate:
                pass
        return cls(spark, path)

    # --- reading ---------------------------------------------------------------

    def versions(self) -> list[int]:
        names = self._files.names(VERSIONS)
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """A version's buckets; the latest by default."""
        number = self.versions()[-1] if number is None else number
        listed = json.loads(self._files.read(f"{VERSIONS}/{number:010d}.json"))
        return Version(number, {int(b): folder for b, folder in listed.items()})

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version; the latest by default."""
        return self._rows(self.version(number).folders.values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.path}/{folder}" for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    # --- writing ---------------------------------------------------------------

    def upsert(self, updates: DataFrame, latest: str | None = None) -> Version:
        """Insert each update, or put it in place of the row of the same key.

        Where keys repeat in ``updates``, the row with the greatest ``latest`` counts; without
        ``latest`` that is an error, and nothing is committed.
        """
        return self._committed(updates, lambda old, new: upsert_by_key(old, new, self.keys), latest)

    def add_missing(self, rows: DataFrame, latest: str | None = None) -> Version:
        """Insert the rows whose key is not there yet; rows that are there stay as they are."""
        return self._committed(rows, lambda old, new: upsert_by_key(new, old, self.keys), latest)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _committed(self, updates: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], latest: str | None) -> Version:
        new = updates.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        staged = f"data/{uuid.uuid4().hex}"
        # Written first: the updates are worked out once, whatever the attempts.
        new.withColumn(BUCKET, self._bucket()).write.parquet(f"{self.path}/{staged}-updates")
        new = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{self.path}/{staged}-updates")
        touched = sorted(r[BUCKET] for r in new.select(BUCKET).distinct().collect())  # a number a bucket at most
        new = new.drop(BUCKET)
        if latest is not None:
            new = upsert_by_key(self.spark.createDataFrame([], self.schema), new, self.keys, latest)
        elif new.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            self._files.delete(f"{staged}-updates")
            raise DuplicateKey(f"updates repeat a key of {self.keys}")
        for attempt in range(ATTEMPTS):
            base = self.version()
            if not touched:
                break
            folder = f"{staged}-{attempt}"
            old = self._rows([base.folders[b] for b in touched if b in base.folders])
            merged = merge(old, new).withColumn(BUCKET, self._bucket())
            merged.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            folders = base.folders | {b: f"{folder}/{BUCKET}={b}" for b in touched}
            if self._files.create(f"{VERSIONS}/{base.number + 1:010d}.json", json.dumps(folders)):
                base = Version(base.number + 1, folders)
                break
            self._files.delete(folder)
        else:
            self._files.delete(f"{staged}-updates")
            raise ConcurrentUpdate(f"{self.path}: other writers were first {ATTEMPTS} times")
        self._files.delete(f"{staged}-updates")
        return base

    def expire(self, keep: int = 1) -> list[int]:
        """Forget all but the last ``keep`` versions and the files that only they name."""
        numbers = self.versions()
        old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
        named = {f for n in kept for f in self.version(n).folders.values()}
        for number in old:
            for folder in set(self.version(number).folders.values()) - named:
                self._files.delete(folder)
            self._files.delete(f"{VERSIONS}/{number:010d}.json")
        return old
