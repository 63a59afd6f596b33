"""Merge-on-read views of a changelog: pure functions from DataFrame to DataFrame.

Order matters.  The snapshot's bound is applied before the newest version of each key is chosen, so an
older version can come forward; tombstones and expired versions are dropped after it, so they still hide
what they replaced.  Key predicates go below the choice by Catalyst and reach the Parquet scan.

The choice is a window with row_number() = 1, which Spark plans with a group limit before the shuffle:
each task sends one row a key at most, however many versions a hot key has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import has_prefix, in_range


def newest(log: DataFrame, *tiebreak: Column) -> DataFrame:
    """The version of highest seq of each key, dead or alive."""
    order = Window.partitionBy("key").orderBy(F.col("seq").desc(), *tiebreak)
    return log.withColumn("ks_rn", F.row_number().over(order)).where("ks_rn = 1").drop("ks_rn")


def before(log: DataFrame, snapshot: int | None) -> DataFrame:
    """Versions that a snapshot sees: seq strictly below it."""
    return log if snapshot is None else log.where(F.col("seq") < F.lit(snapshot))


def expired(now) -> Column:
    """Expired exactly from expires_at on; never without one."""
    return F.coalesce(F.col("expires_at") <= F.lit(now), F.lit(False))


def alive(log: DataFrame, now) -> DataFrame:
    """Rows that are neither tombstones nor expired.  Only for newest versions."""
    return log.where((F.col("op") == "P") & ~expired(now))


def live(log: DataFrame, now, snapshot: int | None = None) -> DataFrame:
    """The newest live version of each key."""
    return alive(newest(before(log, snapshot)), now)


def get(log: DataFrame, key, now, snapshot: int | None = None) -> DataFrame:
    """The key's live version: one row or none."""
    return live(log.where(F.col("key") == F.lit(key)), now, snapshot)


def multi_get(log: DataFrame, keys: DataFrame, now, snapshot: int | None = None) -> DataFrame:
    """Live versions of the keys in ``keys``; Spark broadcasts or shuffles them by their size."""
    return live(log.join(keys.select("key").distinct(), "key", "left_semi"), now, snapshot)


def scan(log: DataFrame, start, end, now, snapshot: int | None = None) -> DataFrame:
    """Live versions with start <= key < end, in key order; None bounds are open."""
    return live(log.where(in_range(F.col("key"), start, end)), now, snapshot).orderBy("key")


def prefix_scan(log: DataFrame, prefix: str | bytes, now, snapshot: int | None = None) -> DataFrame:
    """Live versions whose key has the prefix, in key order; an empty prefix is a full scan."""
    found = log.where(has_prefix(F.col("key"), prefix)) if prefix else log
    return live(found, now, snapshot).orderBy("key")


def next_snapshot(log: DataFrame) -> DataFrame:
    """One row: the snapshot that sees everything logged so far."""
    return log.agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("snapshot"))


def tombstoned(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Keys whose newest version is a delete."""
    return newest(before(log, snapshot)).where("op = 'D'")


def expired_keys(log: DataFrame, now, snapshot: int | None = None) -> DataFrame:
    """Keys whose newest version is a put that has expired."""
    return newest(before(log, snapshot)).where((F.col("op") == "P") & expired(now))


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """Sorted union of key-value sources; equal keys stay, in the order of the sources."""
    tagged = [s.withColumn("source", F.lit(k)) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged).orderBy("key", "source")


def combine(logs: list[DataFrame]) -> DataFrame:
    """One log of several; newer versions win by seq, never by the order of the list."""
    return reduce(DataFrame.unionByName, logs)


def as_of(log: DataFrame, probes: DataFrame, now, stretch: int = 1_000_000) -> DataFrame:
    """For each probe (key, at): the live version of highest seq below ``at``, null if there is none.

    A key's versions and probes are sorted together a stretch of seqs at a time, so a hot key is many
    groups.  What a stretch starts with is the last version of the stretches before: of each, one row
    that is aggregated before the shuffle.
    """
    number = lambda seq: F.floor(seq / stretch).cast("bigint")
    versions = log.select("key", "seq", F.lit(1).alias("ks_side"), F.struct("seq", "op", "value", "expires_at").alias("ks_version"), F.lit(None).cast("bigint").alias("at"))
    wanted = probes.select("key", F.col("at").alias("seq"), F.lit(0).alias("ks_side"), F.lit(None).cast(versions.schema["ks_version"].dataType).alias("ks_version"), F.col("at").cast("bigint").alias("at"))
    both = versions.unionByName(wanted).withColumn("ks_part", number(F.col("seq")))

    ends = both.groupBy("key", "ks_part").agg(F.max("ks_version").alias("ks_end"))
    earlier = Window.partitionBy("key").orderBy("ks_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "ks_part", F.last("ks_end", ignorenulls=True).over(earlier).alias("ks_carried"))

    inside = Window.partitionBy("key", "ks_part").orderBy("seq", "ks_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("ks_last", F.last("ks_version", ignorenulls=True).over(inside)).where("ks_side = 0")
    v = F.coalesce(F.col("ks_last"), F.col("ks_carried"))
    good = (v.getField("op") == "P") & ~F.coalesce(v.getField("expires_at") <= F.lit(now), F.lit(False))
    return found.join(carried, ["key", "ks_part"], "left").select("key", "at", F.when(good, v.getField("seq")).alias("seq"), F.when(good, v.getField("value")).alias("value"))
