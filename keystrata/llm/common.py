"""Helpers shared by the training-data operators.

Every operator takes a DataFrame plus column names, reads only the columns it names (so extra or
clashing columns of the caller never matter), and returns its own columns.  Python code runs in
``mapInArrow`` / ``applyInArrow`` over bounded Arrow batches; nothing here collects rows.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python step handles at once.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where it is unset one in the warehouse."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/keystrata-shared"
        spark.conf.set("spark.checkpoint.dir", where)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, column: str, parts: int, where: str) -> DataFrame:
    """The rows written to ``where`` in buckets, so that grouping them by ``column`` needs no exchange."""
    spark, name = df.sparkSession, f"keystrata_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", where).bucketBy(parts, column).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolves the table while the catalog has it; its files stay  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_clears: list[tuple[str, Callable]] = []


def forgets(module: str, clear: Callable) -> None:
    """``clear`` empties what the operator in ``module`` keeps in a worker between its tasks."""
    _clears.append((module, clear))


def worker_memo(maxsize: int) -> Callable:
    """``lru_cache`` of what outlives an operator's tasks in a worker, until another operator comes."""

    def wrap(fn: Callable) -> Callable:
        made = lru_cache(maxsize)(fn)
        forgets(fn.__module__, made.cache_clear)
        return made

    return wrap


@lru_cache(maxsize=1)
def _malloc_trim() -> Callable:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def trim() -> None:
    """Gives memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def lean(module: str) -> None:
    """Drops what operators of other modules than ``module`` left in this worker."""
    for owner, clear in _clears:
        if owner != module:
            clear()
    trim()


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def map_slices(df: DataFrame, column: str, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded size of ``column``."""
    at = df.columns.index(column)

    def run(batches):
        lean(fn.__module__)
        for part in slices(batches, at, limit):
            out = fn(part)
            if out is not None and out.num_rows:
                yield out
            del out
        trim()

    return df.mapInArrow(run, schema)


def fold(remainder: int, modulus: int, id_col="doc_id"):
    """True for rows whose crc32(id as text) leaves ``remainder``; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Cache(dict):
    """Memo of a pure function, bounded in entries and in characters or bytes of keys and values.

    Two generations, so frequent keys survive a clean-out.
    """

    def __init__(self, fn: Callable, cap: int = 120_000, size: int = 32 << 20):
        super().__init__()
        self.fn, self.cap, self.limit, self.size, self.old = fn, cap, size, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        more = len(key) + len(value)
        if more > self.limit // 16:  # remembered for itself, such an entry would drive out all others
            return value
        self.size += more
        if len(self) >= self.cap or self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size = more
        self[key] = value
        return value
