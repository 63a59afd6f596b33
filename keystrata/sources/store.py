"""A store: a folder of immutable Parquet segments and numbered manifest generations.

    segments/<id>/         Parquet files of one segment, sorted by (key, seq descending)
    manifest/<generation>/ the segments that make up this generation (one small Parquet file)
    quarantine/            what repair set aside

A write first finishes its segment, then its manifest, and last renames the manifest to its generation's
name; readers take the highest generation, so a batch is visible as a whole or not at all, and a failed
writer leaves only unreferenced folders.  Only who holds a generation's claim renames; a claim that is older
than ``Options.claim_seconds`` without its generation is of a dead writer, and is taken over.  A writer that
finds its generation published by another numbers its rows again, after the other's, and tries the next one.

The writes of one handle take turns under its lock.  ``vacuum`` leaves what is younger than a bound alone, as it
may belong to a write that is not published yet; should it go all the same, that write fails and starts again.

Bulk appends number their rows without a global sort: rows are staged with an id made of partition and
row number, and only the partitions' row counts meet to give each partition its first seq.
"""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import byte_size
from ..operators import metrics, reads
from ..plans import compaction
from ..schema import DELETE, PUT, Options, changelog_schema, manifest_schema
from .batch import WriteBatch
from .fs import Fs

COLUMNS = ["key", "seq", "op", "value", "expires_at", "batch_id"]


class Conflict(RuntimeError):
    """Another writer published this generation first."""


class Closed(RuntimeError):
    """The store was closed."""


class RepairReport(NamedTuple):
    corrupted: list[str]
    recovered: list[int]


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.options, self.clock = spark, path.rstrip("/"), options or Options(), clock
        self.fs = Fs(spark, self.path)
        self.kind = self.options.data_type()
        self.reads_done = self.flushes = self.compactions = 0
        self.started, self.closed = clock(), False
        self.held: list[int] = []  # snapshots taken and not released
        self.lock = threading.RLock()  # of writes

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, clock: Callable[[], float] = time.time) -> Store:
        """Opens the folder's latest generation, or creates an empty store."""
        store = cls(spark, path, options, clock)
        for sub in ("segments", "manifest"):
            store.fs.mkdirs(f"{store.path}/{sub}")
        return store

    # -- manifest ---------------------------------------------------------------------------------

    def generation(self) -> int:
        """The latest published generation; 0 for an empty store."""
        return max([int(n) for n in self.fs.names(f"{self.path}/manifest") if n.isdigit()], default=0)

    def manifest(self, generation: int | None = None) -> DataFrame:
        """Segments of a generation; levels, ranges and sizes are columns, so queries on it are plain DataFrames."""
        generation = self.generation() if generation is None else generation
        if not generation:
            return self.spark.createDataFrame([], manifest_schema(self.kind))
        return self.spark.read.schema(manifest_schema(self.kind)).parquet(f"{self.path}/manifest/{generation:08d}")

    def _publish(self, segments: DataFrame, generation: int) -> None:
        name = f"_staged-{uuid.uuid4().hex}"
        staged, target, claim = f"{self.path}/manifest/{name}", f"{self.path}/manifest/{generation:08d}", f"{self.path}/manifest/_claim-{generation:08d}"
        segments.coalesce(1).write.parquet(staged)
        try:
            if self.fs.exists(target) or not self._claim(claim):
                raise Conflict(f"generation {generation} was published by another writer")
            try:
                if missing := [r.path for r in segments.select("path").collect() if not self.fs.exists(f"{self.path}/{r.path}")]:
                    raise Conflict(f"segments were deleted before they were published: {missing}")
                # Onto a folder that is there a rename may fail, or put the staged one inside it.
                if not self.fs.rename(staged, target) or self.fs.exists(f"{target}/{name}"):
                    self.fs.delete(f"{target}/{name}")
                    raise Conflict(f"generation {generation} was published by another writer")
            finally:
                self.fs.delete(claim)
        except Conflict:
            self.fs.delete(staged)
            raise

    def _claim(self, claim: str) -> bool:
        """Takes a claim; one whose writer died is set aside first, by one taker only."""
        if self.fs.create_new(claim):
            return True
        if self.fs.age(claim) <= self.options.claim_seconds:
            return False
        aside = f"{claim}-{uuid.uuid4().hex}"
        if not self.fs.rename(claim, aside):
            return False
        self.fs.delete(aside)
        return self.fs.create_new(claim)

    def _rows(self, segments: DataFrame) -> list:
        return segments.select("segment_id", "level", "min_key", "max_key", "min_seq", "max_seq", "rows", "bytes", "path").collect()

    def _frame(self, rows: list) -> DataFrame:
        return self.spark.createDataFrame([tuple(r) for r in rows], manifest_schema(self.kind))

    # -- log --------------------------------------------------------------------------------------

    def log(self, generation: int | None = None, low=None, high=None) -> DataFrame:
        """Every version in the store; segments whose key range misses [low, high) are not read."""
        self._open()
        manifest = self.manifest(generation)
        if low is not None:
            manifest = manifest.where(F.col("max_key") >= F.lit(low))
        if high is not None:
            manifest = manifest.where(F.col("min_key") < F.lit(high))
        paths = [f"{self.path}/{r.path}" for r in manifest.select("path").collect()]
        schema = changelog_schema(self.kind)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def next_seq(self, generation: int | None = None) -> int:
        return (self.manifest(generation).agg(F.max("max_seq")).first()[0] or 0) + 1

    # -- writes -----------------------------------------------------------------------------------

    def append(self, rows: DataFrame, order_by: str | None = None) -> int:
        """Logs rows (key, op, value[, expires_at]) as one atomic batch and returns the next snapshot.

        Rows take consecutive seqs, in the order of ``order_by`` if it is given.  No rows change nothing.
        """
        self._open()
        with self.lock:
            frame = rows if "expires_at" in rows.columns else rows.withColumn("expires_at", F.lit(None).cast("bigint"))
            if order_by:
                frame = frame.repartitionByRange(order_by).sortWithinPartitions(order_by)
            staged = f"{self.path}/segments/_staged-{uuid.uuid4().hex}"
            key, op = F.col("key").cast(self.kind), F.col("op")
            checked = F.when(key.isNull(), F.raise_error(F.lit("a key is null"))).otherwise(key)
            known = F.when(F.coalesce(op.isin(PUT, DELETE), F.lit(False)), op).otherwise(F.raise_error(F.concat(F.lit("not an operation: "), F.coalesce(op, F.lit("null")))))
            frame.select(checked.alias("key"), known.alias("op"), F.col("value").cast(self.kind).alias("value"), F.col("expires_at").cast("bigint").alias("expires_at"), F.monotonically_increasing_id().alias("mid")).write.parquet(staged)
            try:
                following = self._commit(staged)
            finally:
                self.fs.delete(staged)
            if self.options.auto_compact:
                self.compact()
            return following

    def _commit(self, staged: str) -> int:
        """Numbers staged rows after all that is published, and publishes them; again if another writer was first."""
        read = self.spark.read.parquet(staged)
        part = F.shiftright("mid", 33)
        counts = sorted(read.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task of the write
        for attempt in range(self.options.attempts):
            generation = self.generation()
            first, offsets = self.next_seq(generation), []
            if not counts:
                return first
            for p, n in counts:
                offsets.append((p, first))
                first += n
            offset = F.broadcast(self.spark.createDataFrame(offsets, "part bigint, first bigint"))
            numbered = read.withColumn("part", part).join(offset, "part").withColumn("seq", F.col("first") + F.col("mid").bitwiseAND((1 << 33) - 1))
            final = numbered.withColumn("batch_id", F.lit(generation + 1).cast("bigint")).select(*COLUMNS)
            path = f"segments/{uuid.uuid4().hex}"
            made = self._write_segment(final, path, 0)
            try:
                self._publish(self._frame([*self._rows(self.manifest(generation)), made]), generation + 1)
            except Conflict:
                self.fs.delete(f"{self.path}/{path}")
                if attempt + 1 == self.options.attempts:
                    raise
                time.sleep(0.05 * random.random() * (attempt + 1))
                continue
            self.flushes += 1
            return first
        raise Conflict("no attempts")

    def _write_segment(self, log: DataFrame, path: str, level: int) -> tuple:
        rows = log.select(*COLUMNS)
        total = None
        if level:
            total = rows.count()
            files = max(1, -(-total // self.options.rows_per_file))
            rows = rows.repartitionByRange(files, "key") if files > 1 else rows.coalesce(1)
        writer = rows.sortWithinPartitions("key", F.desc("seq")).write
        if self.options.bloom_keys:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(self.options.bloom_keys))
        writer.parquet(f"{self.path}/{path}")
        return self._describe(path, level)

    def _describe(self, path: str, level: int) -> tuple:
        log = self.spark.read.schema(changelog_schema(self.kind)).parquet(f"{self.path}/{path}")
        r = log.agg(F.min("key"), F.max("key"), F.min("seq"), F.max("seq"), F.count("*"), F.coalesce(F.sum(byte_size(F.col("key")) + byte_size(F.col("value"))), F.lit(0))).first()
        ids = [int(x) for x in [self.manifest().agg(F.max("segment_id")).first()[0]] if x is not None]
        return (max(ids, default=0) + 1, level, r[0], r[1], r[2], r[3], r[4], r[5], path)

    def _one(self, op: str, key, value=None, expires_at: int | None = None) -> int:
        schema = "op string, " + ", ".join(f"{n} {self.kind.simpleString()}" for n in ("key", "value")) + ", expires_at bigint"
        return self.append(self.spark.createDataFrame([(op, key, value, expires_at)], schema))

    def put(self, key, value) -> int:
        """One row a job: for bulk loads use ``append`` or ``write_batch``."""
        return self._one(PUT, key, value)

    def delete(self, key) -> int:
        return self._one(DELETE, key)

    def put_with_ttl(self, key, value, seconds: float) -> int:
        """A put that expires after whole seconds; less than one expires at once."""
        return self._one(PUT, key, value, int(self.clock()) + int(seconds))

    def write_batch(self, batch: WriteBatch | DataFrame) -> int:
        """Applies all operations in their order, visible together; an empty batch changes nothing."""
        if isinstance(batch, WriteBatch):
            if batch.is_empty():
                return self.next_seq()
            batch = batch.to_df(self.spark, self.options)
        return self.append(batch, order_by="ordinal" if "ordinal" in batch.columns else None)

    def snapshot(self) -> int:
        """A point in time that this handle's compactions keep readable until it is released."""
        self.held.append(self.next_seq())
        return self.held[-1]

    def release(self, snapshot: int) -> None:
        self.held.remove(snapshot)

    # -- reads ------------------------------------------------------------------------------------

    def now(self) -> int:
        return int(self.clock())

    def _after(self, key):
        return key + ("\0" if isinstance(key, str) else b"\0")

    def get(self, key) -> DataFrame:
        self.reads_done += 1
        return reads.get(self.log(low=key, high=self._after(key)), key, self.now()).select("key", "value")

    def get_at(self, key, snapshot: int) -> DataFrame:
        return reads.get(self.log(low=key, high=self._after(key)), key, self.now(), snapshot).select("key", "value")

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        return reads.multi_get(self.log(), keys, self.now(), snapshot).select("key", "value")

    def scan(self, start=None, end=None, snapshot: int | None = None) -> DataFrame:
        return reads.scan(self.log(low=start, high=end), start, end, self.now(), snapshot).select("key", "value")

    def prefix_scan(self, prefix, snapshot: int | None = None) -> DataFrame:
        return reads.prefix_scan(self.log(low=prefix or None), prefix, self.now(), snapshot).select("key", "value")

    # -- upkeep -----------------------------------------------------------------------------------

    def compact(self, retain: int | None = None, force: bool = False) -> int:
        """Merges every level that is due (with ``force``, everything into one segment); returns the merges done.

        ``retain``: the oldest snapshot that must stay readable (also for other handles); versions that only
        older ones see may go.  Without it, the oldest that this handle holds, or now.
        """
        self._open()
        done = tries = 0
        while True:
            with self.lock:
                generation = self.generation()
                rows = self._rows(self.manifest(generation))
                step = compaction.choose(rows, self.options, force and not done)
                if step is None:
                    return done
                chosen = [f"{self.path}/{r.path}" for r in step.sources]
                log = self.spark.read.schema(changelog_schema(self.kind)).parquet(*chosen)
                kept = compaction.rewrite(log, self.now(), step.complete, min([self.next_seq(), *self.held]) if retain is None else retain)
                path = f"segments/{uuid.uuid4().hex}"
                made = self._write_segment(kept, path, step.target)
                gone = {r.segment_id for r in step.sources}
                rest = [r for r in rows if r.segment_id not in gone]
                # Keeps the highest seq on record, also if its row went with the merge.
                top = max(r.max_seq or 0 for r in step.sources)
                made = (*made[:5], max(made[5] or 0, top), *made[6:])
                try:
                    self._publish(self._frame([*rest, made]), generation + 1)
                except Conflict:
                    self.fs.delete(f"{self.path}/{path}")
                    tries += 1
                    if tries == self.options.attempts:
                        raise
                    continue
                self.compactions += 1
                done += 1

    def vacuum(self, keep_generations: int = 2, older_than: float = 3600.0) -> list[str]:
        """Deletes segments that none of the last generations refers to, and unfinished writes, of an age in seconds."""
        last = self.generation()
        used = {r.path.split("/")[-1] for g in range(max(1, last - keep_generations + 1), last + 1) if self.fs.exists(f"{self.path}/manifest/{g:08d}") for r in self.manifest(g).select("path").collect()}
        gone = [n for n in self.fs.names(f"{self.path}/segments") if n not in used and self.fs.age(f"{self.path}/segments/{n}") >= older_than]
        for n in gone:
            self.fs.delete(f"{self.path}/segments/{n}")
        return gone

    @classmethod
    def repair(cls, spark: SparkSession, path: str, options: Options | None = None) -> RepairReport:
        """Rebuilds the manifest from the segments that can be read; the others move to ``quarantine``."""
        store = cls.open(spark, path, replace(options or Options(), auto_compact=False))
        good, bad = [], []
        store.fs.mkdirs(f"{store.path}/quarantine")
        for name in store.fs.names(f"{store.path}/segments"):
            at = f"{store.path}/segments/{name}"
            try:
                if name.startswith("_") or not store.fs.exists(f"{at}/_SUCCESS"):
                    raise ValueError("unfinished")
                # All columns of all rows are read, so damage anywhere in the files shows.
                log = spark.read.schema(changelog_schema(store.kind)).parquet(at)
                log.select(F.sum(F.hash(*COLUMNS).cast("bigint"))).first()
                good.append(store._describe(f"segments/{name}", 0))
            except (ValueError, PySparkException, Py4JJavaError):
                bad.append(name)
                store.fs.rename(at, f"{store.path}/quarantine/{name}")
        rows = [(k + 1, *g[1:]) for k, g in enumerate(sorted(good, key=lambda g: (g[4] or 0, g[8])))]
        store._publish(store._frame(rows), store.generation() + 1)
        return RepairReport(bad, [r[0] for r in rows])

    # -- statistics -------------------------------------------------------------------------------

    def metrics(self) -> DataFrame:
        """One row: operations on record (from the log) and this handle's reads, flushes and compactions."""
        counted = metrics.op_metrics(self.log()) if self.generation() else metrics.op_metrics(self.spark.createDataFrame([], changelog_schema(self.kind)))
        return counted.withColumns({"reads": F.lit(self.reads_done).cast("bigint"), "flushes": F.lit(self.flushes).cast("bigint"), "compactions": F.lit(self.compactions).cast("bigint")})

    def stats(self) -> DataFrame:
        """Per level: segments, rows, bytes, and whether a compaction is due."""
        levels = metrics.level_counts(self.manifest(), self.options.l0_threshold, self.options.max_levels)
        return levels.join(self.manifest().groupBy("level").agg(F.sum("bytes").alias("bytes")), "level").orderBy("level")

    def health(self) -> dict:
        return {"status": "closed" if self.closed else "ok", "generation": self.generation(), "uptime_seconds": int(self.clock() - self.started)}

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.path)

    def close(self) -> None:
        """Waits for a running write, releases the handle's snapshots, and refuses what comes after."""
        with self.lock:
            self.held.clear()
            self.closed = True
