"""Folders and tables that every executor sees, and text helpers the operators share."""

from __future__ import annotations

import ctypes
import os
import shutil
import site
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it by themselves.

    They do if it is installed, on PYTHONPATH, or in the folder Spark was started from.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd(), *site.getsitepackages()]
    if context.applicationId in _SHIPPED or any(p and Path(p).resolve() == root for p in places):
        return
    _SHIPPED.add(context.applicationId)
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='catalens-')}/catalens", "zip", root, "catalens")
    context.addPyFile(archive)  # a file of the driver's, which Spark serves to the executors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under the warehouse where that is unset.

    Both are shared by all executors, so what is written there outlives any of them.
    """
    ship_package(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there, and a lost executor
    costs a re-read."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text (null as empty)."""
    return F.md5(F.coalesce(text, F.lit("")))


def release_memory() -> None:
    """For the end of a task: workers live on between tasks and stages, and Arrow would keep
    the buffers of the largest batches from the JVM and from whatever the worker does next, as
    the C library would what numpy and others have freed."""
    pa.default_memory_pool().release_unused()
    # Of glibc; other systems do without.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; memory is given back once all that it held is gone."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return whole


def map_texts(
    docs: DataFrame,
    text_col: str,
    keep: Sequence[Column | str],
    new: Mapping[str, tuple[str, pa.DataType]],
    start: Callable[[], Callable[[list[str | None]], Sequence[object]]],
) -> DataFrame:
    """The columns ``keep`` as they are, and new ones worked out from the texts in Python.

    ``new`` gives each new column's Spark and Arrow type.  ``start`` runs once a task and
    returns the function from a batch of texts to the new columns.
    """

    def started() -> Callable[[pa.Array], Sequence[object]]:
        work = start()
        return lambda texts: work(texts.to_pylist())

    return map_columns(docs, text_col, keep, new, started)


def map_columns(
    docs: DataFrame,
    text_col: str,
    keep: Sequence[Column | str],
    new: Mapping[str, tuple[str, pa.DataType]],
    start: Callable[[], Callable[[pa.Array], Sequence[object]]],
    at_once: int | None = None,
) -> DataFrame:
    """``map_texts`` of a function of the texts as an Arrow array.

    ``at_once`` bounds the bytes of texts that are handled together, a single text aside.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).alias("__llm_text"))
    kept = rows.drop("__llm_text").schema
    schema = T.StructType([*kept.fields, *[f for name, (kind, _) in new.items() for f in T.StructType.fromDDL(f"`{name}` {kind}").fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for whole in batches:
            for batch in [whole] if at_once is None else sliced(whole, whole.column(whole.num_columns - 1), at_once):
                columns = work(batch.column(batch.num_columns - 1))
                arrays = [pa.array(c, type=kind) for c, (_, kind) in zip(columns, new.values())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=schema.names)

    return rows.mapInArrow(releasing(run), schema)


def sliced(rows: pa.RecordBatch | pa.Array, texts: pa.Array, at_once: int) -> Iterator[pa.RecordBatch | pa.Array]:
    """``rows`` in slices of about ``at_once`` bytes of ``texts``, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + at_once)))
        yield rows.slice(at, to - at)
        at = to
