import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from keystrata.functions.keys import prefix_successor
from keystrata.operators import reads
from keystrata.plans.compaction import rewrite
from keystrata.schema import changelog_schema
from pyspark.sql import types as T


def frame(spark, rows, kind=None):
    """rows: (key, seq, op, value, expires_at)"""
    return spark.createDataFrame([(*r, None) for r in rows], changelog_schema(kind))


def pairs(df):
    return [(r.key, r.value) for r in df.select("key", "value").collect()]


def model(rows, now, snapshot=None):
    best = {}
    for key, seq, op, value, expires in rows:
        if (snapshot is None or seq < snapshot) and seq > best.get(key, (0,))[0]:
            best[key] = (seq, op, value, expires)
    return {k: v[2] for k, v in best.items() if v[1] == "P" and (v[3] is None or v[3] > now)}


LOG = [("a", 1, "P", "1", None), ("b", 2, "P", "2", None), ("a", 3, "P", "3", None), ("b", 4, "D", None, None), ("c", 5, "P", "5", 100), ("c", 6, "P", "6", 50), ("d", 7, "P", "", None)]


def test_live_hides_tombstones_and_expired(spark):
    log = frame(spark, LOG)
    assert dict(pairs(reads.live(log, 10))) == {"a": "3", "c": "6", "d": ""}
    # An expired newest version hides older ones that haven't expired.
    assert dict(pairs(reads.live(log, 60))) == {"a": "3", "d": ""}
    assert dict(pairs(reads.live(log, 50))) == {"a": "3", "d": ""}  # expired exactly at its time


def test_snapshot_is_strict_and_sees_overwritten_versions(spark):
    log = frame(spark, LOG)
    assert dict(pairs(reads.live(log, 10, 3))) == {"a": "1", "b": "2"}
    assert dict(pairs(reads.live(log, 10, 4))) == {"a": "3", "b": "2"}
    assert pairs(reads.get(log, "b", 10)) == [] and pairs(reads.get(log, "b", 10, 4)) == [("b", "2")]
    assert reads.next_snapshot(log).first().snapshot == 8
    assert reads.next_snapshot(log.where("false")).first().snapshot == 1


def test_ranges(spark):
    log = frame(spark, LOG)
    assert pairs(reads.scan(log, "a", "d", 10)) == [("a", "3"), ("c", "6")]
    assert pairs(reads.scan(log, "d", "a", 10)) == [] and pairs(reads.scan(log, "a", "a", 10)) == []
    assert pairs(reads.scan(log, None, None, 10)) == [("a", "3"), ("c", "6"), ("d", "")]


def test_prefix_edges(spark):
    assert prefix_successor(b"") is None and prefix_successor(b"\xff\xff") is None
    assert prefix_successor(b"a\xff") == b"b" and prefix_successor(b"ab") == b"ac"
    keys = [b"", b"a", b"a\xff", b"a\xff\x01", b"b", b"b\xff", b"\xff", b"\xff\xff\x00"]
    log = frame(spark, [(k, i + 1, "P", k, None) for i, k in enumerate(keys)], T.BinaryType())
    for p in (b"", b"a", b"a\xff", b"b", b"\xff", b"\xff\xff"):
        assert [bytes(k) for k, _ in pairs(reads.prefix_scan(log, p, 0))] == sorted(k for k in keys if k.startswith(p)), p


def test_key_filter_reaches_the_scan(spark, tmp_path):
    frame(spark, LOG).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = reads.get(log, "a", 10)._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan and "WindowGroupLimit" in plan


def test_merge_keeps_equal_keys_in_source_order(spark):
    one = spark.createDataFrame([("x", "new"), ("y", "1")], "key string, value string")
    two = spark.createDataFrame([("x", "old"), ("z", "2")], "key string, value string")
    assert pairs(reads.merge_sources([one, two])) == [("x", "new"), ("x", "old"), ("y", "1"), ("z", "2")]


OPS = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from("PPD"), st.sampled_from(["", "v", "w"]), st.sampled_from([None, None, 5, 50])), min_size=1, max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS, st.integers(1, 26), st.integers(0, 60))
def test_model(spark, ops, snapshot, now):
    rows = [(k, i + 1, op, v if op == "P" else None, e if op == "P" else None) for i, (k, op, v, e) in enumerate(ops)]
    log = frame(spark, rows[::-1])
    assert dict(pairs(reads.live(log, now))) == model(rows, now)
    assert dict(pairs(reads.live(log, now, snapshot))) == model(rows, now, snapshot)
    kept = rewrite(log, now, True, snapshot)
    assert dict(pairs(reads.live(kept, now))) == model(rows, now)
    assert dict(pairs(reads.live(kept, now, snapshot))) == model(rows, now, snapshot)


def test_partial_compaction_keeps_what_hides_older_versions(spark):
    newer = frame(spark, [("a", 5, "D", None, None), ("b", 6, "P", "6", 1)])
    older = frame(spark, [("a", 1, "P", "1", None), ("b", 2, "P", "2", None)])
    assert pairs(reads.live(reads.combine([rewrite(newer, 10, False, 100), older]), 10)) == []
    assert rewrite(newer, 10, True, 100).count() == 0


@pytest.mark.parametrize("at,value", [(1, None), (2, "1"), (4, "3"), (5, None)])
def test_as_of(spark, at, value):
    log = frame(spark, [("a", 1, "P", "1", None), ("a", 3, "P", "3", None), ("a", 4, "D", None, None)])
    probes = spark.createDataFrame([("a", at)], "key string, at bigint")
    for stretch in (1, 2, 1000):
        assert reads.as_of(log, probes, 0, stretch).first().value == value
