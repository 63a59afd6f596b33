"""Registered queries over the shared tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import events_log, orders_log, scratch, segmented, table, user_key
from .functions import scalars
from .operators import layout, metrics, reads
from .plans import compaction
from .schema import Options
from .sources.store import Store
from .streaming import latest

NOW = "2024-02-01 00:00:00"
LATER = "2024-02-10 00:00:00"
SNAPSHOT = 501  #: of the events log: sees its first 500 events


def now():
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


# -- reads ----------------------------------------------------------------------------------------


def latest_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.live(events_log(spark, sf_dir), now()).select("key", "value", "seq")


def get_point(spark, sf_dir):
    return reads.get(events_log(spark, sf_dir), "user:000007", now()).select("key", "value", "seq")


def multi_get(spark, sf_dir):
    keys = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(user_key().alias("key"))
    return reads.multi_get(events_log(spark, sf_dir), keys, now()).select("key", "value")


def scan_range(spark, sf_dir):
    return reads.scan(events_log(spark, sf_dir), "user:000010", "user:000020", now()).select("key", "value")


def scan_empty_range(spark, sf_dir):
    return reads.scan(events_log(spark, sf_dir), "user:000020", "user:000010", now()).select("key", "value")


def prefix_scan(spark, sf_dir):
    return reads.prefix_scan(events_log(spark, sf_dir), "user:00001", now()).select("key", "value")


def binary_prefix_scan(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("key", F.col("key").cast("binary"))
    return reads.prefix_scan(log, b"user:00001", now()).select(F.col("key").cast("string").alias("key"), "value")


def snapshot_get_at(spark, sf_dir):
    return reads.get(events_log(spark, sf_dir), "user:000007", now(), SNAPSHOT).select("key", "value", "seq")


def snapshot_scan(spark, sf_dir):
    return reads.live(events_log(spark, sf_dir), now(), SNAPSHOT).select("key", "value", "seq")


def next_snapshot(spark, sf_dir):
    return reads.next_snapshot(events_log(spark, sf_dir))


def tombstoned_keys(spark, sf_dir):
    return reads.tombstoned(events_log(spark, sf_dir)).select("key", "seq")


def ttl_expired_keys(spark, sf_dir):
    return reads.expired_keys(events_log(spark, sf_dir), F.expr(f"TIMESTAMP_NTZ '{LATER}'")).select("key", "seq")


def ttl_live_keys(spark, sf_dir):
    return reads.live(events_log(spark, sf_dir), now()).where("expires_at IS NOT NULL").select("key", "expires_at")


def as_of_lookup(spark, sf_dir):
    probes = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(user_key().alias("key"), (F.col("event_id") + 1).alias("at"))
    return reads.as_of(events_log(spark, sf_dir), probes, now()).select("key", "at", "seq", "value")


# -- writes ---------------------------------------------------------------------------------------


def _batch(spark, sf_dir):
    """Puts for users divisible by 4 and deletes for those divisible by 6, after all events."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    base = 10_000_000
    puts = users.where("user_id % 4 = 0").select(user_key().alias("key"), (F.lit(base) + F.col("user_id")).alias("seq"), F.lit("P").alias("op"), F.lit("batched").alias("value"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    deletes = users.where("user_id % 6 = 0").select(user_key().alias("key"), (F.lit(2 * base) + F.col("user_id")).alias("seq"), F.lit("D").alias("op"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    return puts.unionByName(deletes)


def write_batch_apply(spark, sf_dir):
    return reads.live(reads.combine([events_log(spark, sf_dir), _batch(spark, sf_dir)]), now()).select("key", "value", "seq")


def bulk_put_orders(spark, sf_dir):
    return reads.live(orders_log(spark, sf_dir), now()).select("key", "value", "seq")


def merge_sources(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_regionkey").cast("string").alias("value"))
    return reads.merge_sources([n, r, n.where("value < '2'")])


def store_round_trip(spark, sf_dir):
    """The events log written to a store in several batches, compacted, and read back at once."""
    store = Store.open(spark, scratch(spark, "store"), Options(l0_threshold=3), clock=lambda: 0.0)
    log = events_log(spark, sf_dir).withColumn("ordinal", F.col("seq")).select("ordinal", "op", "key", "value")
    bounds = [0, *[r[0] for r in [log.agg(F.max("ordinal")).first()]]]
    step = -(-(bounds[-1] or 1) // 4)
    for k in range(4):
        store.write_batch(log.where((F.col("ordinal") > k * step) & (F.col("ordinal") <= (k + 1) * step)))
    return store.scan()


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.lit("P").alias("op"), F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"), F.col("n_regionkey").alias("region"))


def store_single_writes(spark, sf_dir):
    """Puts, deletes and expiries one by one over a bulk load, at a clock of their own."""
    store = Store.open(spark, scratch(spark, "store"), Options(auto_compact=False), clock=lambda: 1000.0)
    store.append(_nations(spark, sf_dir).drop("region"))
    store.put("CANADA", "new")
    store.delete("BRAZIL")
    store.put_with_ttl("FRANCE", "gone at once", 0.5)
    store.put_with_ttl("KENYA", "kept", 60)
    store.put("BRAZIL AND MORE", "")
    return store.scan()


def store_snapshot_after_compaction(spark, sf_dir):
    """What a snapshot saw, read after later writes and a full merge."""
    store = Store.open(spark, scratch(spark, "store"), Options(auto_compact=False), clock=lambda: 1000.0)
    store.append(_nations(spark, sf_dir).drop("region"))
    before = store.snapshot()
    store.append(_nations(spark, sf_dir).where("region = 1").select(F.lit("D").alias("op"), "key", F.lit(None).cast("string").alias("value")))
    store.compact(force=True)
    return store.scan(snapshot=before).select("key", F.col("value").alias("before")).join(store.scan().select("key", F.col("value").alias("after")), "key", "left")


def store_repair(spark, sf_dir):
    """A store that lost its manifests: repair finds all segments."""
    store = Store.open(spark, scratch(spark, "store"), Options(auto_compact=False), clock=lambda: 1000.0)
    for region in range(3):
        store.append(_nations(spark, sf_dir).where(F.col("region") == region).drop("region"))
    store.fs.delete(f"{store.path}/manifest")
    Store.repair(spark, store.path)
    return Store.open(spark, store.path, clock=lambda: 1000.0).scan()


def store_vacuum(spark, sf_dir):
    """What is left after a merge and a clean-up of all that is old."""
    store = Store.open(spark, scratch(spark, "store"), Options(auto_compact=False), clock=lambda: 1000.0)
    for region in range(3):
        store.append(_nations(spark, sf_dir).where(F.col("region") == region).drop("region"))
    store.compact(force=True)
    gone = store.vacuum(1, 0)
    return store.scan().agg(F.count("*").alias("keys")).select("keys", F.lit(len(gone)).alias("deleted"), F.lit(store.manifest().count()).alias("segments"))


def concurrent_puts(spark, sf_dir):
    """Two handles on one store, two threads each: no write is lost."""
    path = scratch(spark, "store")
    handles = [Store.open(spark, path, Options(auto_compact=False), clock=lambda: 1000.0) for _ in range(2)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: handles[k % 2].put(f"thread {k % 4}", f"{k // 4}"), range(8)))
    return handles[0].log().select("key", "value")


def manifest_totals(spark, sf_dir):
    return metrics.totals(metrics.segment_ranges(_segments(spark, sf_dir)))


# -- segments and compaction ----------------------------------------------------------------------


def _segments(spark, sf_dir):
    return segmented(events_log(spark, sf_dir))


def segments_minmax(spark, sf_dir):
    return metrics.segment_ranges(_segments(spark, sf_dir))


def segments_overlap(spark, sf_dir):
    ranges = metrics.segment_ranges(segmented(orders_log(spark, sf_dir)))
    wanted = spark.createDataFrame([("order:0000000500", "order:0000001200")], "min_key string, max_key string")
    return metrics.overlapping(ranges, wanted).select("segment_id", "min_key", "max_key", "rows")


def compact_full(spark, sf_dir):
    return compaction.rewrite(events_log(spark, sf_dir), now(), True, 1 << 62).select("key", "seq", "op", "value")


def compact_partial(spark, sf_dir):
    return compaction.rewrite(events_log(spark, sf_dir), now(), False, 1 << 62).select("key", "seq", "op", "value")


def compact_retained(spark, sf_dir):
    return compaction.rewrite(events_log(spark, sf_dir), now(), True, SNAPSHOT).select("key", "seq", "op", "value")


def level_counts(spark, sf_dir):
    ranges = metrics.segment_ranges(_segments(spark, sf_dir)).withColumn("level", (F.col("segment_id") % 3).cast("int"))
    return metrics.level_counts(ranges)


def op_metrics(spark, sf_dir):
    return metrics.op_metrics(events_log(spark, sf_dir))


# -- layout and scalars ---------------------------------------------------------------------------


def value_bytes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("key"), F.col("text").alias("value"))
    return metrics.log_bytes(d)


def block_entries(spark, sf_dir):
    return layout.entry_sizes(orders_log(spark, sf_dir)).select("key", "entry_bytes")


def block_split(spark, sf_dir):
    return layout.blocks(segmented(orders_log(spark, sf_dir), 5000))


def shared_prefix(spark, sf_dir):
    return layout.prefix_compression(segmented(orders_log(spark, sf_dir)))


def bloom_words(spark, sf_dir):
    return layout.bloom_build(segmented(orders_log(spark, sf_dir)), 1000)


def bloom_probe(spark, sf_dir):
    """Probes that the filters let through though no segment has them, and those of a segment's own keys."""
    log = segmented(orders_log(spark, sf_dir))
    foreign = table(spark, sf_dir, "orders").select(F.concat(F.lit("probe:"), F.col("o_orderkey").cast("string")).alias("key"))
    filters = layout.bloom_build(log, 1000)
    own = layout.bloom_held(filters, log, 1000).agg(F.count("*").alias("n"))
    named = lambda frame, name: frame.select(F.lit(name).alias("probes"), "n")
    return named(layout.bloom_passes(filters, foreign, 1000), "foreign").union(named(own, "own"))


def record_crc32(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return log.select("seq", scalars.record_crc32(F.col("op"), F.col("key"), F.col("value")).alias("crc"))


def fnv_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", scalars.fnv1a32("n_name").alias("hash"))


def value_hex(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", scalars.spaced_hex(F.col("n_name")).alias("spaced"), F.lower(F.hex("n_name")).alias("plain"))


def kv_response(spark, sf_dir):
    """Fields of a lookup's reply for every user, found or not."""
    users = table(spark, sf_dir, "events").select(user_key().alias("key")).distinct()
    found = reads.live(events_log(spark, sf_dir), now()).select("key", "value")
    out = users.join(found, "key", "left")
    return out.select(F.col("value").isNotNull().alias("found"), "key", "value", F.lower(F.hex("value")).alias("value_hex"))


def lossy_text(spark, sf_dir):
    """Values that are not UTF-8, as text and as shown."""
    value = F.concat(F.col("n_name").cast("binary"), F.unhex(F.lit("FF41C3")))
    return table(spark, sf_dir, "nation").select("n_nationkey", scalars.lossy_text(value).alias("text"), scalars.shown(value).alias("shown"), scalars.shown(F.col("n_name").cast("binary")).alias("plain"))


def labels_of_numbers(spark, sf_dir):
    """Display forms: uptimes, file names, sequence labels, op codes."""
    o = table(spark, sf_dir, "events").select("event_id", "event_type")
    op = F.when(F.col("event_type") == "error", "D").otherwise("P")
    return o.select("event_id", scalars.uptime(F.col("event_id") * 7).alias("uptime"), scalars.segment_file(F.col("event_id")).alias("file"), scalars.seq_label(F.col("event_id")).alias("label"), scalars.op_code(op).alias("code"), scalars.op_name(scalars.op_code(op)).alias("op"))


def stream_latest(spark, sf_dir):
    """The newest version of each key, kept up by a stream over the events and read when it has caught up."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    error = F.col("event_type") == "error"
    log = stream.select(user_key().alias("key"), (F.col("event_id") + 1).alias("seq"), F.when(error, "D").otherwise("P").alias("op"), F.when(~error, F.col("event_type")).alias("value"), F.lit(None).cast("bigint").alias("expires_at"))
    out = scratch(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/result")

    query = latest.latest_updates(log).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/result").select("key", "seq", "op", "value")


_NAMES = """latest_live get_point multi_get scan_range scan_empty_range prefix_scan binary_prefix_scan snapshot_get_at snapshot_scan
next_snapshot tombstoned_keys ttl_expired_keys ttl_live_keys as_of_lookup write_batch_apply bulk_put_orders merge_sources
store_round_trip store_single_writes store_snapshot_after_compaction store_repair store_vacuum concurrent_puts manifest_totals lossy_text segments_minmax segments_overlap compact_full compact_partial compact_retained level_counts op_metrics
value_bytes block_entries block_split shared_prefix bloom_words bloom_probe record_crc32 fnv_hash value_hex kv_response
labels_of_numbers stream_latest""".split()

QUERIES = {name: globals()[name] for name in _NAMES}

# -- SQL ------------------------------------------------------------------------------------------

_E = """e AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op,
  CASE WHEN event_type <> 'error' THEN event_type END AS value,
  CASE WHEN event_type = 'view' THEN ts + INTERVAL 3 DAY END AS expires_at FROM events)"""
_O = """o AS (SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderkey + 1 AS seq, 'P' AS op,
  o_orderstatus AS value FROM orders)"""
_TOP = "SELECT * FROM {0} WHERE {1} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"
_ALIVE = f"op = 'P' AND (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}')"


def _live(columns: str, versions: str = "true", rows: str = "true", log: str = "e") -> str:
    return f"WITH {_E}, n AS ({_TOP.format(log, versions)}) SELECT {columns} FROM n WHERE {_ALIVE} AND {rows}"


_B = """b AS (SELECT * FROM e UNION ALL
  SELECT DISTINCT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0'), 10000000 + user_id, 'P', 'batched', NULL FROM events WHERE user_id % 4 = 0 UNION ALL
  SELECT DISTINCT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0'), 20000000 + user_id, 'D', NULL, NULL FROM events WHERE user_id % 6 = 0)"""
_LCP = "list_max(list_transform(range(0, CAST(least(strlen(key), strlen(p)) AS BIGINT) + 1), lambda i: CASE WHEN substr(key, 1, CAST(i AS INTEGER)) = substr(p, 1, CAST(i AS INTEGER)) THEN i ELSE 0 END))"

_BYTES = "list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, CAST(i AS INTEGER), 1)) AS BIGINT))"  # of ASCII text
_M32 = 4294967295


def _fnv(text: str, basis: int) -> str:
    return f"list_reduce(list_prepend(CAST({basis} AS BIGINT), {_BYTES.format(text)}), lambda h, c: (xor(h, c) * 16777619) & {_M32})"


def _positions(keys: str) -> str:
    """(key, pos): the bits of 10,000 that each distinct key of ``keys`` sets by 7 hashes."""
    return f"""SELECT DISTINCT segment_id, key, ((h1 + i * h2) & {_M32}) % 10000 AS pos FROM (
        SELECT segment_id, key, {_fnv("key", 2166136261)} AS h1, (2 * {_fnv("key", 2166136261 ^ 16777619)} + 1) & {_M32} AS h2 FROM (SELECT DISTINCT segment_id, key FROM {keys})), range(7) AS r(i)"""


_S = "s AS (SELECT CAST((seq - 1) // 1000 AS BIGINT) AS segment_id, key FROM o)"
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform({0}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)"


def _le32(n: str) -> str:
    return f"[{n} & 255, {n} >> 8 & 255, {n} >> 16 & 255, {n} >> 24 & 255]"


ORACLE_SQL = {
    "store_single_writes": """SELECT n_name AS key, CASE n_name WHEN 'CANADA' THEN 'new' WHEN 'KENYA' THEN 'kept' ELSE CAST(n_nationkey AS VARCHAR) END AS value
        FROM nation WHERE n_name NOT IN ('BRAZIL', 'FRANCE') UNION ALL SELECT 'BRAZIL AND MORE', ''
        UNION ALL SELECT k, v FROM (VALUES ('CANADA', 'new'), ('KENYA', 'kept')) AS x(k, v) WHERE k NOT IN (SELECT n_name FROM nation)""",
    "store_snapshot_after_compaction": "SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS before, CASE WHEN n_regionkey <> 1 THEN CAST(n_nationkey AS VARCHAR) END AS after FROM nation",
    "store_repair": "SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation WHERE n_regionkey < 3",
    "store_vacuum": "SELECT count(*) AS keys, 3 AS deleted, 1 AS segments FROM nation WHERE n_regionkey < 3",
    "concurrent_puts": "SELECT 'thread ' || t AS key, CAST(n AS VARCHAR) AS value FROM range(4) AS x(t), range(2) AS y(n)",
    "manifest_totals": f"""WITH {_E}, r AS (SELECT CAST((seq - 1) // 1000 AS BIGINT) AS segment_id, min(key) AS low, max(key) AS high, count(*) AS n FROM e GROUP BY 1)
        SELECT count(*) AS segments, max(segment_id) AS max_segment_id, min(low) AS min_key, max(high) AS max_key, CAST(sum(n) AS BIGINT) AS rows FROM r""",
    "lossy_text": "SELECT n_nationkey, n_name || chr(65533) || 'A' || chr(65533) AS text, trim(regexp_replace(lower(hex(n_name)) || 'ff41c3', '(..)', '\\1 ', 'g')) AS shown, n_name AS plain FROM nation",
    "fnv_hash": f"SELECT n_name, {_fnv('n_name', 2166136261)} AS hash FROM nation",
    "bloom_words": f"""WITH {_O}, {_S}, p AS (SELECT DISTINCT segment_id, pos FROM ({_positions("s")})),
        w AS (SELECT segment_id, pos // 64 AS word, sum(CAST(1 AS HUGEINT) << CAST(pos % 64 AS INTEGER)) AS b FROM p GROUP BY 1, 2)
        SELECT segment_id, word, CAST(CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END AS BIGINT) AS bits FROM w""",
    "bloom_probe": f"""WITH {_O}, {_S}, p AS (SELECT segment_id, key, pos FROM ({_positions("s")})), held AS (SELECT DISTINCT segment_id, pos FROM p),
        x AS (SELECT 0 AS segment_id, 'probe:' || CAST(o_orderkey AS VARCHAR) AS key FROM orders), q AS (SELECT key, pos FROM ({_positions("x")})),
        need AS (SELECT key, count(*) AS n FROM q GROUP BY key), got AS (SELECT q.key, h.segment_id, count(*) AS n FROM q JOIN held h USING (pos) GROUP BY 1, 2)
        SELECT 'foreign' AS probes, count(*) AS n FROM got JOIN need USING (key, n) UNION ALL SELECT 'own', count(*) FROM (SELECT DISTINCT segment_id, key FROM s)""",
    "record_crc32": f"""WITH {_E}, r AS (SELECT seq, CASE op WHEN 'P' THEN 1 ELSE 2 END AS code, key, coalesce(value, '') AS v FROM e)
        SELECT seq, xor({_CRC.format(f"flatten([[CAST(code AS BIGINT)], {_le32('length(key)')}, {_BYTES.format('key')}, {_le32('length(v)')}, {_BYTES.format('v')}])")}, {_M32}) AS crc FROM r""",
    "block_split": f"""WITH RECURSIVE {_O}, s AS (SELECT CAST((seq - 1) // 5000 AS BIGINT) AS segment_id, key, 8 + strlen(key) + strlen(value) AS size,
          row_number() OVER (PARTITION BY (seq - 1) // 5000 ORDER BY key, seq) AS n FROM o),
        c AS (SELECT *, sum(size) OVER (PARTITION BY segment_id ORDER BY n) AS total FROM s),
        b AS (SELECT segment_id, CAST(0 AS BIGINT) AS block, CAST(1 AS BIGINT) AS n, CAST(0 AS HUGEINT) AS before FROM c GROUP BY segment_id UNION ALL
          SELECT b.segment_id, b.block + 1, min(c.n), min(c.total - c.size) FROM b JOIN c ON c.segment_id = b.segment_id AND c.n > b.n AND c.total > b.before + 4096 GROUP BY b.segment_id, b.block),
        e AS (SELECT *, lead(n) OVER (PARTITION BY segment_id ORDER BY block) AS stop FROM b)
        SELECT e.segment_id, e.block, count(*) AS entries, CAST(sum(c.size) AS BIGINT) AS bytes, min(c.key) AS first_key, max(c.key) AS last_key
        FROM e JOIN c ON c.segment_id = e.segment_id AND c.n >= e.n AND (e.stop IS NULL OR c.n < e.stop) GROUP BY 1, 2""",
    "latest_live": _live("key, value, seq"),
    "get_point": _live("key, value, seq", "key = 'user:000007'"),
    "multi_get": _live("key, value", "key IN (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') FROM events WHERE user_id % 3 = 0)"),
    "scan_range": _live("key, value", "key >= 'user:000010' AND key < 'user:000020'"),
    "scan_empty_range": _live("key, value", "key >= 'user:000020' AND key < 'user:000010'"),
    "prefix_scan": _live("key, value", "key LIKE 'user:00001%'"),
    "binary_prefix_scan": _live("key, value", "key LIKE 'user:00001%'"),
    "snapshot_get_at": _live("key, value, seq", f"key = 'user:000007' AND seq < {SNAPSHOT}"),
    "snapshot_scan": _live("key, value, seq", f"seq < {SNAPSHOT}"),
    "next_snapshot": f"WITH {_E} SELECT coalesce(max(seq), 0) + 1 AS snapshot FROM e",
    "tombstoned_keys": f"WITH {_E}, n AS ({_TOP.format('e', 'true')}) SELECT key, seq FROM n WHERE op = 'D'",
    "ttl_expired_keys": f"WITH {_E}, n AS ({_TOP.format('e', 'true')}) SELECT key, seq FROM n WHERE op = 'P' AND expires_at <= TIMESTAMP '{LATER}'",
    "ttl_live_keys": _live("key, expires_at", rows="expires_at IS NOT NULL"),
    "as_of_lookup": f"""WITH {_E}, p AS (SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id + 1 AS at FROM events WHERE event_type = 'purchase')
        SELECT p.key, p.at, CASE WHEN {_ALIVE} THEN e.seq END AS seq, CASE WHEN {_ALIVE} THEN e.value END AS value
        FROM p ASOF LEFT JOIN e ON p.key = e.key AND p.at > e.seq""",
    "write_batch_apply": f"WITH {_E}, {_B}, n AS ({_TOP.format('b', 'true')}) SELECT key, value, seq FROM n WHERE {_ALIVE}",
    "bulk_put_orders": f"WITH {_O} SELECT key, value, seq FROM o",
    "merge_sources": """SELECT n_name AS key, CAST(n_nationkey AS VARCHAR) AS value, 0 AS source FROM nation UNION ALL
        SELECT r_name, CAST(r_regionkey AS VARCHAR), 1 FROM region UNION ALL
        SELECT n_name, CAST(n_nationkey AS VARCHAR), 2 FROM nation WHERE CAST(n_nationkey AS VARCHAR) < '2'""",
    "store_round_trip": f"WITH {_E}, n AS ({_TOP.format('e', 'true')}) SELECT key, value FROM n WHERE op = 'P'",
    "segments_minmax": f"WITH {_E} SELECT CAST((seq - 1) // 1000 AS BIGINT) AS segment_id, min(key) AS min_key, max(key) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq, count(*) AS rows FROM e GROUP BY 1",
    "segments_overlap": f"""WITH {_O}, r AS (SELECT CAST((seq - 1) // 1000 AS BIGINT) AS segment_id, min(key) AS min_key, max(key) AS max_key, count(*) AS rows FROM o GROUP BY 1)
        SELECT * FROM r WHERE max_key >= 'order:0000000500' AND min_key <= 'order:0000001200'""",
    "compact_full": _live("key, seq, op, value"),
    "compact_partial": f"WITH {_E} SELECT key, seq, op, value FROM ({_TOP.format('e', 'true')})",
    "compact_retained": f"""WITH {_E} SELECT key, seq, op, value FROM e WHERE seq >= {SNAPSHOT} UNION ALL
        SELECT key, seq, op, value FROM ({_TOP.format('e', f'seq < {SNAPSHOT}')}) WHERE {_ALIVE}""",
    "level_counts": f"""WITH {_E}, r AS (SELECT (seq - 1) // 1000 AS segment_id, count(*) AS rows FROM e GROUP BY 1),
        c AS (SELECT CAST(segment_id % 3 AS INTEGER) AS level, count(*) AS segments, CAST(sum(rows) AS BIGINT) AS rows FROM r GROUP BY 1)
        SELECT level, segments, rows, CAST(4 * pow(10, level) AS BIGINT) AS "limit", segments >= CAST(4 * pow(10, level) AS BIGINT) AND level < 6 AS due FROM c""",
    "op_metrics": f"WITH {_E} SELECT count(*) FILTER (op = 'P') AS writes, count(*) FILTER (op = 'D') AS deletes, count(*) FILTER (op = 'P' AND expires_at IS NOT NULL) AS ttl_writes, count(*) AS ops FROM e",
    "value_bytes": "SELECT count(*) AS rows, CAST(sum(strlen('doc:' || CAST(doc_id AS VARCHAR))) AS BIGINT) AS key_bytes, CAST(sum(strlen(text)) AS BIGINT) AS value_bytes FROM documents",
    "block_entries": f"WITH {_O} SELECT key, CAST(8 + strlen(key) + strlen(value) AS INTEGER) AS entry_bytes FROM o",
    "shared_prefix": f"""WITH {_O}, s AS (SELECT CAST((seq - 1) // 1000 AS BIGINT) AS segment_id, key, lag(key) OVER (PARTITION BY (seq - 1) // 1000 ORDER BY key, seq) AS p FROM o)
        SELECT segment_id, count(*) AS entries, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes, CAST(sum(coalesce({_LCP}, 0)) AS BIGINT) AS shared_bytes FROM s GROUP BY 1""",
    "value_hex": "SELECT n_nationkey, trim(regexp_replace(lower(hex(n_name)), '(..)', '\\1 ', 'g')) AS spaced, lower(hex(n_name)) AS plain FROM nation",
    "kv_response": f"""WITH {_E}, n AS ({_TOP.format('e', 'true')}), l AS (SELECT key, value FROM n WHERE {_ALIVE})
        SELECT value IS NOT NULL AS found, key, value, lower(hex(value)) AS value_hex FROM (SELECT DISTINCT key FROM e) LEFT JOIN l USING (key)""",
    "labels_of_numbers": """WITH s AS (SELECT event_id, event_type, event_id * 7 AS t FROM events)
        SELECT event_id, CASE WHEN t >= 86400 THEN (t // 86400) || 'd ' || (t % 86400 // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's'
          WHEN t >= 3600 THEN (t // 3600) || 'h ' || (t % 3600 // 60) || 'm ' || (t % 60) || 's'
          ELSE (t // 60) || 'm ' || (t % 60) || 's' END AS uptime,
          lpad(CAST(event_id AS VARCHAR), 6, '0') || '.parquet' AS file, 'seq:' || event_id AS label,
          CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS code, CASE WHEN event_type = 'error' THEN 'D' ELSE 'P' END AS op FROM s""",
    "stream_latest": f"WITH {_E} SELECT key, seq, op, value FROM ({_TOP.format('e', 'true')})",
}
