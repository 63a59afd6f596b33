import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keystrata.functions import scalars
from keystrata.operators import layout, metrics
from keystrata.queries import QUERIES
from keystrata.streaming import latest


def one(spark, col, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


def test_crc_of_records(spark):
    for op, code, key, val in (("P", 1, "k", "välue"), ("D", 2, "", None)):
        raw = bytes((code,)) + struct.pack("<I", len(key)) + key.encode() + struct.pack("<I", len((val or "").encode())) + (val or "").encode()
        rows = spark.createDataFrame([(op, key, val)], "op string, k string, v string")
        assert rows.select(scalars.record_crc32(F.col("op"), F.col("k"), F.col("v"))).first()[0] == zlib.crc32(raw)


def test_hex_text_and_uptime(spark):
    rows = spark.createDataFrame([(b"\xff\x00a",), (b"ok",), (b"",)], "v binary")
    got = rows.select(scalars.spaced_hex(F.col("v")), scalars.shown(F.col("v")), scalars.lossy_text(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("ff 00 61", "ff 00 61", "�\0a"), ("6f 6b", "ok", "ok"), ("", "", "")]
    ups = spark.createDataFrame([(0,), (61,), (3600,), (90061,)], "s bigint").select(scalars.uptime(F.col("s"))).collect()
    assert [r[0] for r in ups] == ["0m 0s", "1m 1s", "1h 0m 0s", "1d 1h 1m 1s"]


@pytest.mark.parametrize("a,b,n", [("abc", "abd", 2), ("abc", "abc", 3), ("", "a", 0), ("é", "è", 1), (None, "a", 0), ("ab", "abc", 2)])
def test_shared_prefix(spark, a, b, n):
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    assert rows.select(scalars.shared_prefix(F.col("a"), F.col("b"))).first()[0] == n


def test_fnv(spark):
    rows = spark.createDataFrame([("",), ("a",), ("foobar",)], "k string")
    assert [r[0] for r in rows.select(scalars.fnv1a32("k")).collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]


def test_blocks_are_greedy(spark):
    log = spark.createDataFrame([(s, f"k{i:03}", i + 1, "v" * (i % 5)) for i in range(60) for s in (1, 2)], "segment_id bigint, key string, seq bigint, value string")
    got = sorted(tuple(r) for r in layout.blocks(log, 60).collect())
    wanted = []
    for s in (1, 2):
        at = None
        for i in range(60):
            size = 8 + 4 + i % 5
            if at is None or at[3] + size > 60:
                at = [s, at[1] + 1 if at else 0, 0, 0, f"k{i:03}", None]
                wanted.append(at)
            at[2], at[3], at[5] = at[2] + 1, at[3] + size, f"k{i:03}"
    assert got == [tuple(w) for w in wanted]


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    log = spark.range(2000).selectExpr("id % 2 AS segment_id", "concat('key_', id) AS key")
    filters = layout.bloom_build(log, 1000).persist()
    held = layout.bloom_may_contain(filters, log, 1000).join(log, ["segment_id", "key"], "left_semi").count()
    assert held == 2000
    probes = spark.range(5000).selectExpr("concat('probe_', id) AS key")
    assert layout.bloom_may_contain(filters, probes, 1000).count() < 2 * 5000 * 0.02


@pytest.mark.parametrize("of", ["concat('key_', id)", "encode(repeat('x', int(id % 7)) || id, 'utf-8')"])
def test_bloom_filters_of_many_segments_equal_a_test_of_each(spark, of):
    log = spark.range(3000).selectExpr("(id * 7919) % 150 * 1000003 AS segment_id", f"{of} AS key")
    probes = spark.range(2500, 4000).selectExpr(f"{of} AS key").union(spark.sql(f"SELECT {of} AS key FROM VALUES (0), (0), (null) AS x(id)"))
    filters = layout.bloom_build(log, 20).persist()  # 200 bits, which end inside a word
    sets, (bits, hashes) = {}, layout.bloom_shape(20)
    raw = lambda k: k.encode() if isinstance(k, str) else bytes(k)
    for r in filters.collect():
        sets.setdefault(r.segment_id, set()).update(r.word * 64 + i for i in range(64) if r.bits >> i & 1)

    def wanted(keys):
        at = layout.bloom_positions(*layout.bloom_hashes(keys), bits, hashes).tolist()
        return sorted((s, raw(k)) for s, held in sets.items() for k, p in zip(keys, at, strict=True) if held.issuperset(p))

    got = sorted((r.segment_id, raw(r.key)) for r in layout.bloom_may_contain(filters, probes, 20).collect())
    assert len(sets) == 150 and got == wanted([r.key for r in probes.where("key IS NOT NULL").distinct().collect()])
    assert [r.n for r in layout.bloom_passes(filters, probes, 20).collect()] == [len(got)]
    # Keys of one segment that are tested against another's filter, rows that come twice, and nulls.
    other = log.selectExpr("(segment_id + 1000003) % (150 * 1000003) AS segment_id", "key")
    own = layout.bloom_held(filters, log.union(other).union(other).union(spark.sql("SELECT null AS segment_id, null AS key")), 20).collect()
    every, pairs = set(wanted([r.key for r in log.collect()])), {(r.segment_id, raw(r.key)) for r in log.union(other).collect()}
    assert sorted((r.segment_id, raw(r.key)) for r in own if r.key is not None) == sorted(every & pairs)
    assert sum(r.key is None for r in own) == 1


def test_bloom_probe_makes_no_row_for_each_probe_and_segment(spark, tmp_path):
    """A row for each word that a probe and a segment have in common would be 280 million rows here."""
    spark.range(200_000).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus").write.parquet(str(tmp_path / "orders.parquet"))
    frame = QUERIES["bloom_probe"](spark, str(tmp_path))
    assert "Join" not in frame._jdf.queryExecution().optimizedPlan().toString()
    got = {r.probes: r.n for r in frame.collect()}
    own, foreign = (layout.bloom_positions(*layout.bloom_hashes(pa.array(f"{name}{i:0{n}}" for i in range(200_000))), 10_000, 7) for name, n in (("order:", 10), ("probe:", 1)))
    passed = 0
    for segment in range(200):
        held = np.zeros(10_000, bool)
        held[own[segment * 1000 : segment * 1000 + 1000]] = True
        passed += int(held[foreign].all(1).sum())
    assert got == {"own": 200_000, "foreign": passed}


def test_bloom_filters_of_no_rows(spark):
    none, some = (spark.range(n).selectExpr("id AS segment_id", "concat('key_', id) AS key") for n in (0, 9))
    for log, probes in ((none, some), (some, none), (none, none)):
        filters = layout.bloom_build(log, 10)
        assert layout.bloom_passes(filters, probes, 10).collect()[0].n == 0
        assert layout.bloom_may_contain(filters, probes, 10).count() == layout.bloom_held(filters, probes, 10).count() == 0


def test_level_counts_and_overlap(spark):
    m = spark.createDataFrame([(1, 0, "aaa", "mmm", 1), (2, 0, "nnn", "zzz", 1), (3, 1, "a", "z", 1), (4, 2, "0", "9", 1)], "segment_id bigint, level int, min_key string, max_key string, rows bigint")
    assert {r.level: (r.segments, r.due) for r in metrics.level_counts(m, 2).collect()} == {0: (2, True), 1: (1, False), 2: (1, False)}
    bounds = spark.createDataFrame([("mmm", "nnn")], "min_key string, max_key string")
    assert sorted(r.segment_id for r in metrics.overlapping(m, bounds).collect()) == [1, 2, 3]


@pytest.mark.parametrize("make,mode", [(latest.latest_updates, "complete"), (latest.latest_state, "update")])
def test_stream_equals_batch(spark, tmp_path, make, mode):
    rows = [("a", 3, "P", "3", None), ("a", 1, "P", "1", None), ("b", 2, "P", "2", 9), ("b", 4, "D", None, None), ("b", 2, "P", "2", 9), ("a", 2, "P", "2", None)]
    schema = "key string, seq bigint, op string, value string, expires_at bigint"
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = {}

    def keep(batch, _):
        for r in batch.collect():
            seen[r.key] = (r.seq, r.op, r.value)

    make(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert seen == {"a": (3, "P", "3"), "b": (4, "D", None)}
