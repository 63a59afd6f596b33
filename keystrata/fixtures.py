"""Changelogs derived from the shared tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, or in the warehouse where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/keystrata"
    return f"{root.rstrip('/')}/{name}-{uuid4().hex}"


def user_key(col="user_id"):
    return F.concat(F.lit("user:"), F.lpad(F.col(col).cast("string"), 6, "0"))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrites, deletes (errors) and three-day expiry (views) of one key per user."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    return e.select(
        user_key().alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(error, "D").otherwise("P").alias("op"),
        F.when(~error, F.col("event_type")).alias("value"),
        F.when(F.col("event_type") == "view", F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk load without overwrites."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"),
        (F.col("o_orderkey") + 1).alias("seq"),
        F.lit("P").alias("op"),
        F.col("o_orderstatus").alias("value"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"),
    )


def segmented(log: DataFrame, rows: int = SEGMENT_ROWS) -> DataFrame:
    """The log with the number of the segment that each version was flushed to."""
    return log.withColumn("segment_id", F.floor((F.col("seq") - 1) / rows).cast("bigint"))
