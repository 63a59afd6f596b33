"""An ordered list of puts and deletes that is applied as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import DELETE, PUT, Options


class WriteBatch:
    def __init__(self) -> None:
        self.ops: list[tuple[str, object, object]] = []

    def put(self, key, value) -> WriteBatch:
        self.ops.append((PUT, key, value))
        return self

    def delete(self, key) -> WriteBatch:
        self.ops.append((DELETE, key, None))
        return self

    def is_empty(self) -> bool:
        return not self.ops

    def __len__(self) -> int:
        return len(self.ops)

    def to_df(self, spark: SparkSession, options: Options) -> DataFrame:
        """Rows (ordinal, op, key, value); for large batches pass a DataFrame of that form instead."""
        kind = options.data_type()
        schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", kind), T.StructField("value", kind)])
        return spark.createDataFrame([(i, *op) for i, op in enumerate(self.ops)], schema)
