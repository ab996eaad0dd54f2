"""Tables stored by the key they share, so that joining them moves nothing.

Both sides are written into as many buckets by a hash of the key, sorted by it, and Spark
joins bucket with bucket.  A bucket is read by one task, so keys that would fill more than
a bucket by themselves are found when the table is written; their rows are kept apart,
dealt out evenly, and meet a copy of the few rows they join.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalens.operators.skew import PARTS, default_parts, heavy_keys
from catalens.sources.store import shared_folder, shared_table


def store_by_key(df: DataFrame, key: str, name: str, buckets: int | None = None, folder: str | None = None) -> DataFrame:
    """``df`` as a table of this session's catalogue, in buckets of ``key``; one file each.

    The files lie under ``folder`` or the session's shared folder.  Two tables of as many
    buckets join on their keys without a shuffle.
    """
    spark = df.sparkSession
    buckets = buckets or default_parts(df)
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark, folder)}/{table}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


@dataclass(frozen=True)
class StoredLinks:
    """A link table stored by ``key``: rows in buckets, and those of heavy keys apart."""

    key: str
    light: DataFrame
    heavy: DataFrame
    #: The heavy keys: fewer than there are buckets.
    heavy_keys: DataFrame

    @classmethod
    def store(cls, links: DataFrame, key: str, name: str, buckets: int | None = None, folder: str | None = None) -> StoredLinks:
        """Rows with a NULL key are dropped, as no join would keep them."""
        buckets = buckets or default_parts(links)
        links = links.where(F.col(key).isNotNull())
        heavy = shared_table(heavy_keys(links, key, buckets).drop(PARTS), f"{name}-keys", folder)
        few = F.broadcast(heavy)  # fewer rows than buckets
        light = store_by_key(links.join(few, key, "left_anti").select(*links.columns), key, name, buckets, folder)
        apart = links.join(few, key, "left_semi").select(*links.columns)
        return cls(key, light, shared_table(apart, f"{name}-heavy", folder), heavy)

    def joined(self, few: DataFrame, on: str, *columns: str) -> DataFrame:
        """Inner join with ``few``, which is stored in as many buckets of ``on`` and unique on
        it: the links' columns and ``columns`` of ``few``."""
        names = [*self.light.columns, *columns]
        side = few.select(F.col(on).alias(self.key), *columns)
        light = self.light.join(side, self.key).select(*names)
        wanted = side.join(F.broadcast(self.heavy_keys), self.key, "left_semi")
        heavy = self.heavy.join(F.broadcast(wanted), self.key).select(*names)
        return light.unionByName(heavy)
