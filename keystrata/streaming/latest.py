"""Latest version per key of a stream of mutations.

``latest_updates`` is an aggregate: for each key the version of highest seq so far.  ``latest_state`` keeps
the same in a stateful operator, which also emits only real changes.  Both compare seqs, so late and
repeated rows do no harm, and both keep a delete's seq, or an older put that arrives late would come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "seq bigint, op string, value string, expires_at bigint"


def latest_updates(stream: DataFrame) -> DataFrame:
    """(key, seq, op, value, expires_at): for output mode update or complete."""
    newest = F.max(F.struct("seq", "op", "value", "expires_at")).alias("v")
    return stream.groupBy("key").agg(newest).select("key", "v.seq", "v.op", "v.value", "v.expires_at")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = tuple(state.get) if state.exists else None
    best = held
    for rows in batches:
        if len(rows):
            r = rows.loc[rows["seq"].idxmax()]
            if best is None or int(r["seq"]) > best[0]:
                best = (int(r["seq"]), r["op"], None if pd.isna(r["value"]) else r["value"], None if pd.isna(r["expires_at"]) else int(r["expires_at"]))
    if best is not None and best != held:
        state.update(best)
        yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]], "expires_at": pd.array([best[3]], dtype="Int64")})


def latest_state(stream: DataFrame) -> DataFrame:
    """The same with explicit state of one version a key: for output mode update."""
    return stream.select("key", "seq", "op", "value", "expires_at").groupBy("key").applyInPandasWithState(_step, f"key string, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_ops(stream: DataFrame, at: str = "ts", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Puts and deletes per event-time window, with a watermark for late rows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size).alias("w")).agg(F.count_if(F.col("op") == "P").alias("writes"), F.count_if(F.col("op") == "D").alias("deletes")).select(F.col("w.start").alias("window_start"), "writes", "deletes")


def into_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream of mutations to a changelog folder, each micro-batch once; returns the query."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)
