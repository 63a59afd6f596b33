"""Schemas and options of changelogs, segments and manifests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PUT, DELETE = "P", "D"


def changelog_schema(kind: T.DataType | None = None) -> T.StructType:
    """Rows of a changelog: one mutation each.  ``kind`` is the type of keys and values (string or binary)."""
    kind = kind or T.StringType()
    return T.StructType(
        [
            T.StructField("key", kind, False),
            T.StructField("seq", T.LongType(), False),
            T.StructField("op", T.StringType(), False),
            T.StructField("value", kind, True),
            T.StructField("expires_at", T.LongType(), True),  # epoch seconds
            T.StructField("batch_id", T.LongType(), True),
        ]
    )


def manifest_schema(kind: T.DataType | None = None) -> T.StructType:
    kind = kind or T.StringType()
    return T.StructType(
        [
            T.StructField("segment_id", T.LongType(), False),
            T.StructField("level", T.IntegerType(), False),
            T.StructField("min_key", kind, True),
            T.StructField("max_key", kind, True),
            T.StructField("min_seq", T.LongType(), True),
            T.StructField("max_seq", T.LongType(), True),
            T.StructField("rows", T.LongType(), False),
            T.StructField("bytes", T.LongType(), False),
            T.StructField("path", T.StringType(), False),
        ]
    )


@dataclass(frozen=True)
class Options:
    """Tunables of a store."""

    key_type: str = "string"  #: or "binary"
    l0_threshold: int = 4  #: segments of level 0 that trigger a compaction; each level has ten times more
    max_levels: int = 7
    rows_per_file: int = 5_000_000  #: of a compacted segment
    auto_compact: bool = True
    bloom_keys: int = 0  #: expected distinct keys per row group; over 0, files get a Parquet bloom filter on key

    claim_seconds: float = 60.0  #: after which an unfinished publication counts as dead
    attempts: int = 30  #: to publish, while other writers are first

    def data_type(self) -> T.DataType:
        return T.BinaryType() if self.key_type == "binary" else T.StringType()
