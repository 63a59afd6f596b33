import pytest

from keystrata.cli import main, parse_batch
from keystrata.schema import Options
from keystrata.server import respond
from keystrata.sources.batch import WriteBatch
from keystrata.sources.store import Closed, Conflict, Store


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def clock():
    return Clock()


@pytest.fixture
def store(spark, tmp_path, clock):
    return Store.open(spark, str(tmp_path / "db"), Options(l0_threshold=4), clock)


def value(frame):
    row = frame.first()
    return row and row.value


def test_put_get_delete_reopen(spark, store, clock):
    store.put("name", "one")
    assert value(store.get("name")) == "one" and value(store.get("nam")) is None
    store.write_batch(WriteBatch().put("a", "a long value of more than eight bytes").put("name", "two").delete("gone"))
    again = Store.open(spark, store.path, store.options, clock)
    assert value(again.get("name")) == "two" and value(again.get("a")) == "a long value of more than eight bytes"
    assert value(again.get_at("name", 2)) == "one"
    before = again.snapshot()
    assert before == 5
    again.delete("name")
    again.compact(force=True)
    assert value(again.get("name")) is None and value(again.get_at("name", before)) == "two"


def test_batches_number_rows_in_order_and_empty_ones_do_nothing(spark, store):
    rows = spark.range(500).selectExpr("id AS ordinal", "'P' AS op", "concat('k', id % 10) AS key", "cast(id AS string) AS value").repartition(7)
    assert store.write_batch(rows) == 501
    assert {r.key: r.value for r in store.scan().collect()} == {f"k{i}": str(490 + i) for i in range(10)}
    generation = store.generation()
    assert store.write_batch(WriteBatch()) == 501 and store.generation() == generation
    assert store.append(rows.where("false").drop("ordinal")) == 501 and store.generation() == generation
    seqs = sorted(r.seq for r in store.log().collect())
    assert seqs == list(range(1, 501))


def test_expiry_in_whole_seconds(store, clock):
    store.put_with_ttl("t", "v", 2.9)
    store.put_with_ttl("now", "v", 0.5)
    assert value(store.get("t")) == "v" and value(store.get("now")) is None
    clock.now += 2
    assert value(store.get("t")) is None


def test_compaction_levels_and_retained_snapshots(spark, store):
    for i in range(7):
        store.write_batch(WriteBatch().put("k", str(i)).put(f"x{i}", "x").delete(f"x{i - 1}"))
    levels = {r.level: r.segments for r in store.stats().collect()}
    assert max(levels) >= 1 and store.compactions >= 1
    assert {r.key: r.value for r in store.scan().collect()} == {"k": "6", "x6": "x"}
    snapshot = store.snapshot()
    store.write_batch(WriteBatch().put("k", "later").delete("x6"))
    store.compact(retain=snapshot, force=True)
    assert value(store.get_at("k", snapshot)) == "6" and value(store.get_at("x6", snapshot)) == "x"
    assert {r.key: r.value for r in store.scan().collect()} == {"k": "later"}
    store.write_batch(WriteBatch().delete("k"))
    store.compact(force=True)
    assert store.scan().count() == 0 and store.next_seq() > snapshot
    assert not store.vacuum(1) and store.vacuum(1, 0) and store.scan().count() == 0


def test_repair_sets_damage_aside(spark, store, tmp_path):
    store.options = Options(auto_compact=False)
    for i in range(3):
        store.put(f"k{i}", str(i))
    bad = store.manifest().where("min_key = 'k1'").first().path
    for f in (tmp_path / "db" / bad).glob("part-*"):
        f.write_bytes(b"damaged")
    for f in (tmp_path / "db" / bad).glob(".*.crc"):
        f.unlink()
    report = Store.repair(spark, store.path)
    assert len(report.corrupted) == 1 and len(report.recovered) == 2
    assert {r.key for r in Store.open(spark, store.path).scan().collect()} == {"k0", "k2"}
    assert list((tmp_path / "db" / "quarantine").iterdir())


def test_one_writer_wins(store):
    store.put("a", "1")
    with pytest.raises(Conflict):
        store._publish(store.manifest(), store.generation())
    assert store.manifest().count() == 1 and [n for n in store.fs.names(f"{store.path}/manifest") if n.startswith("_")] == []
    store.close()
    with pytest.raises(Closed):
        store.put("a", "2")


def test_a_dead_writer_does_not_wedge_the_store(spark, store, clock):
    store.put("a", "1")
    claim = f"{store.path}/manifest/_claim-{store.generation() + 1:08d}"
    store.fs.create_new(claim)
    hasty = Store.open(spark, store.path, Options(claim_seconds=3600, attempts=2), clock)
    with pytest.raises(Conflict):  # its writer may still be at it
        hasty.put("b", "2")
    patient = Store.open(spark, store.path, Options(claim_seconds=0.0), clock)
    patient.put("b", "2")
    store.fs.create_new(f"{store.path}/manifest/_claim-{patient.generation() + 1:08d}")
    report = Store.repair(spark, store.path, Options(claim_seconds=0.0))
    assert not report.corrupted and sorted(r.key for r in Store.open(spark, store.path, clock=clock).scan().collect()) == ["a", "b"]


def test_vacuum_during_a_write(spark, store, clock, monkeypatch):
    """A clean-up between a segment and its publication leaves it alone, or makes the write start again."""
    publish = Store._publish
    for age in (3600.0, 0.0):
        calls = []

        def late(self, segments, generation, age=age, calls=calls):
            if not calls:
                calls.append(Store.open(spark, store.path, clock=clock).vacuum(older_than=age))
            publish(self, segments, generation)

        monkeypatch.setattr(Store, "_publish", late)
        if age:
            store.put("k", "1")
            assert calls == [[]]
        else:  # the staged rows went as well: the write fails as a whole, and the store is as it was
            with pytest.raises(Exception, match="_staged|PATH_NOT_FOUND|not exist"):
                store.put("lost", "1")
        monkeypatch.setattr(Store, "_publish", publish)
        assert [r.key for r in store.scan().collect()] == ["k"]
    store.put("l", "2")
    assert [r.key for r in store.scan().collect()] == ["k", "l"]


def test_bad_rows_are_refused(spark, store):
    for key, op in ((None, "P"), ("k", "X"), ("k", None)):
        with pytest.raises(Exception, match="a key is null|not an operation"):
            store.append(spark.createDataFrame([(op, key, "v")], "op string, key string, value string"))
    assert store.generation() == 0


def test_http_and_cli(spark, store, capsys):
    import json

    assert respond(store, "POST", "/api/put", b'{"key": "a b", "value": "\xc3\xa9"}')[0] == 200
    assert respond(store, "POST", "/api/put", b"no")[0] == 400 and respond(store, "GET", "/nowhere")[0] == 404
    assert json.loads(respond(store, "GET", "/api/get/a%20b")[2]) == {"found": True, "key": "a b", "value": "é", "value_hex": "c3 a9"}
    assert not json.loads(respond(store, "GET", "/api/get/none")[2])["found"]
    assert json.loads(respond(store, "GET", "/api/metrics")[2])["writes"] == 1
    assert b"<table>" in respond(store, "GET", "/")[2]
    assert respond(store, "POST", "/api/delete/a%20b")[0] == 200 and respond(store, "POST", "/api/compact")[0] == 200
    assert json.loads(respond(store, "GET", "/api/health")[2])["status"] == "ok"
    assert json.loads(respond(store, "GET", "/api/stats")[2])["levels"]
    assert parse_batch(["put", "k", "v", "delete", "k"]).ops[-1][0] == "D"
    assert main(["--path", store.path, "batch", "put", "c", "1", "delete", "c"], spark) == 0
    assert main(["--path", store.path, "get", "c"], spark) == 1
    assert main(["--path", store.path, "put", "d", "4"], spark) == 0
    assert main(["--path", store.path, "scan", "a", "z"], spark) == 0
    assert capsys.readouterr().out == "d\t4\n"


def test_binary_keys_that_look_like_headers(spark, tmp_path):
    store = Store.open(spark, str(tmp_path / "b"), Options(key_type="binary"))
    store.put(b"\x00", b"\x01" + bytes(8))
    store.put(b"\x01", b"\x00")
    assert [(bytes(r.key), bytes(r.value)) for r in store.scan().collect()] == [(b"\x00", b"\x01" + bytes(8)), (b"\x01", b"\x00")]
