"""Counters and statistics as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import byte_size


def op_metrics(log: DataFrame) -> DataFrame:
    """One row: puts, deletes, puts with expiry, rows and distinct batches of a log."""
    return log.agg(
        F.count_if(F.col("op") == "P").alias("writes"),
        F.count_if(F.col("op") == "D").alias("deletes"),
        F.count_if((F.col("op") == "P") & F.col("expires_at").isNotNull()).alias("ttl_writes"),
        F.count("*").alias("ops"),
    )


def level_counts(manifest: DataFrame, l0_threshold: int = 4, max_levels: int = 7) -> DataFrame:
    """Per level: segments, rows, the number of segments that triggers a compaction, whether it is reached."""
    limit = (F.lit(l0_threshold) * F.pow(F.lit(10), F.col("level"))).cast("bigint")
    counted = manifest.groupBy("level").agg(F.count("*").alias("segments"), F.sum("rows").alias("rows"))
    return counted.withColumn("limit", limit).withColumn("due", (F.col("segments") >= F.col("limit")) & (F.col("level") < max_levels - 1))


def segment_ranges(log: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Per segment: least and greatest key and seq, rows."""
    return log.groupBy(segment).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("rows"))


def totals(segments: DataFrame) -> DataFrame:
    """One row over all segments: how many, the highest id, the least and greatest key, rows."""
    return segments.agg(F.count("*").alias("segments"), F.max("segment_id").alias("max_segment_id"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def log_bytes(log: DataFrame) -> DataFrame:
    """One row: rows, bytes of keys, bytes of values."""
    return log.agg(F.count("*").alias("rows"), F.coalesce(F.sum(byte_size(F.col("key"))), F.lit(0)).alias("key_bytes"), F.coalesce(F.sum(byte_size(F.col("value"))), F.lit(0)).alias("value_bytes"))


def overlapping(segments: DataFrame, low_high: DataFrame) -> DataFrame:
    """Segments whose closed key range meets one of ``low_high`` (min_key, max_key): a theta semi join of metadata."""
    a, b = segments.alias("a"), low_high.alias("b")
    return a.join(b, (F.col("a.max_key") >= F.col("b.min_key")) & (F.col("a.min_key") <= F.col("b.max_key")), "left_semi")
