"""Analytics of the physical layout: blocks, prefix compression, bloom filters.

Blocks follow a greedy rule (a block ends when the next entry would exceed its size), which depends on
every entry before; it is computed exactly inside one segment at a time, from sorted Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FNV_BASIS, FNV_PRIME, _fnv1a, byte_size, shared_prefix

# Bytes of a block entry's header; bits a key; filters, and 64-bit words for all probes, that are tested at once.
ENTRY_HEADER, BITS_PER_KEY, TESTED_FILTERS, TESTED_WORDS = 8, 10, 4096, 1 << 16


def entry_sizes(log: DataFrame) -> DataFrame:
    """Bytes that each entry takes in a block."""
    return log.withColumn("entry_bytes", F.lit(ENTRY_HEADER) + byte_size(F.col("key")) + byte_size(F.col("value")))


def prefix_compression(log: DataFrame, segment: str = "segment_id") -> DataFrame:
    """Per segment: bytes of keys, and bytes left if each key leaves out what it shares with the one before."""
    before = F.lag("key").over(Window.partitionBy(segment).orderBy("key", "seq"))
    shared = log.withColumn("shared", shared_prefix(before, F.col("key")))
    return shared.groupBy(segment).agg(F.count("*").alias("entries"), F.sum(byte_size(F.col("key"))).alias("key_bytes"), F.sum("shared").alias("shared_bytes"))


def blocks(log: DataFrame, block_bytes: int = 4096, segment: str = "segment_id") -> DataFrame:
    """(segment_id, block, entries, bytes, first_key, last_key) by the greedy rule, in key order.

    Tasks stream their sorted segments; a segment's running block is all that is held.
    """
    kind = log.schema["key"].dataType.simpleString()
    sized = entry_sizes(log).select(F.col(segment).alias("segment_id"), "key", "seq", "entry_bytes")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["segment_id", "block", "entries", "bytes", "first_key", "last_key"], None
        held = None  # of the block that the batches so far end in: [segment, block, entries, bytes, first, last]
        for batch in batches:
            types = types or [pa.int64(), pa.int64(), pa.int64(), pa.int64(), batch.schema.field(1).type, batch.schema.field(1).type]
            seg, size, keys, n = batch.column(0).to_numpy(), batch.column(3).to_numpy().astype(np.int64), batch.column(1), batch.num_rows
            ends = np.cumsum(size)
            done, i = [], 0
            while i < n:  # a step a block: the first entry that is of another segment, or too much
                stop = int(np.searchsorted(seg, seg[i], "right"))
                if held and held[0] != seg[i]:
                    done.append(held)
                    held = None
                before = int(ends[i - 1]) if i else 0
                room = block_bytes - (held[3] if held else 0)
                last = min(stop, int(np.searchsorted(ends, before + room, "right")))
                if last == i and held and held[2]:
                    done.append(held)
                    held = [held[0], held[1] + 1, 0, 0, None, None]
                    continue
                last = max(last, i + 1)
                held = held or [int(seg[i]), 0, 0, 0, None, None]
                held[2], held[3] = held[2] + last - i, held[3] + int(ends[last - 1]) - before
                held[4], held[5], i = keys[i].as_py() if held[4] is None else held[4], keys[last - 1].as_py(), last
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(held, types, strict=True)], names)

    ordered = sized.withColumn("segment_id", F.col("segment_id").cast("bigint")).repartition("segment_id").sortWithinPartitions("segment_id", "key", "seq")
    return ordered.mapInArrow(split, f"segment_id bigint, block bigint, entries bigint, bytes bigint, first_key {kind}, last_key {kind}")


def bloom_shape(keys: int, bits_per_key: int = BITS_PER_KEY) -> tuple[int, int]:
    """Bits and hashes of a filter for so many keys."""
    return max(64, keys * bits_per_key), min(30, max(1, round(bits_per_key * math.log(2))))


def bloom_hashes(keys) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 32 bits of each key; the second is odd, and FNV-1a from another basis."""
    return _fnv1a(keys, FNV_BASIS), 2 * _fnv1a(keys, FNV_BASIS ^ FNV_PRIME) + 1 & 0xFFFFFFFF


def bloom_positions(first: np.ndarray, second: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bits of each key by double hashing in 32 bits: h1 + i * h2."""
    return (first[:, None] + np.arange(hashes) * second[:, None] & 0xFFFFFFFF) % bits


def bloom_build(log: DataFrame, keys: int, bits_per_key: int = BITS_PER_KEY, segment: str = "segment_id") -> DataFrame:
    """(segment_id, word, bits): the set 64-bit words of each segment's filter; equal words are combined before the shuffle."""
    bits, hashes = bloom_shape(keys, bits_per_key)
    width = -(-bits // 64)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = bloom_positions(*bloom_hashes(batch.column(1)), bits, hashes).ravel()
            seg, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            code = np.repeat(of.astype(np.int64) * width, hashes) + at // 64
            order = np.argsort(code)
            code, mask = code[order], (np.uint64(1) << (at % 64).astype(np.uint64))[order]
            begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            code, held = code[begin], np.bitwise_or.reduceat(mask, begin)
            yield pa.RecordBatch.from_arrays([pa.array(seg[code // width]), pa.array(code % width), pa.array(held.view(np.int64))], ["segment_id", "word", "bits"])

    # A key that comes twice sets the same bits, so keys need not be made distinct.
    found = log.select(F.col(segment).cast("bigint").alias("segment_id"), "key").where("segment_id IS NOT NULL AND key IS NOT NULL")
    return found.mapInArrow(words, "segment_id bigint, word bigint, bits bigint").groupBy("segment_id", "word").agg(F.bit_or("bits").alias("bits"))


def _strips(filters: DataFrame, bits: int) -> DataFrame:
    """(segments, data): filters of up to 64 segments side by side: for each bit of a filter as few bytes as have a bit for each segment."""
    width = -(-bits // 64)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, held = [], np.zeros((64, width), "<u8")

        def strip() -> pa.RecordBatch:
            parts = (held[: len(segments), i : i + 1024].copy().view(np.uint8) for i in range(0, width, 1024))
            turned = (np.packbits(np.unpackbits(part, axis=1, bitorder="little"), axis=0, bitorder="little").T.tobytes() for part in parts)
            return pa.RecordBatch.from_arrays([pa.array([segments], pa.list_(pa.int64())), pa.array([b"".join(turned)])], ["segments", "data"])

        for batch in batches:
            seg, word, mask = (batch.column(i).to_numpy() for i in range(3))
            edges = [*np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]])[: len(seg)]).tolist(), len(seg)]
            for start, stop in zip(edges, edges[1:], strict=False):
                if not segments or segments[-1] != seg[start]:
                    if len(segments) == 64:
                        yield strip()
                        segments, held[:] = [], 0
                    segments.append(int(seg[start]))
                held[len(segments) - 1, word[start:stop]] = mask[start:stop].view(np.uint64)
        if segments:
            yield strip()

    # Eight segments that are numbered one after another meet in a task, so that bytes are full at any number of tasks.
    return filters.select("segment_id", "word", "bits").repartition(F.shiftright("segment_id", 3)).sortWithinPartitions("segment_id").mapInArrow(lay, "segments array<bigint>, data binary")


def _pass(filters: DataFrame, probes: DataFrame, keys: int, bits_per_key: int, pairs: bool) -> DataFrame:
    """All distinct probes against all filters: (segment_id, key) of those let through, or parts of their count as n.

    The two hashes of a probe go to one task, and every strip of filters to all of these tasks, which hold their probes
    (8 bytes each, and keys if pairs are wanted) and let the strips pass: one AND of 64-bit words tests 64 segments.
    """
    bits, hashes = bloom_shape(keys, bits_per_key)
    spark, kind = probes.sparkSession, probes.schema["key"].dataType.simpleString()
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a task, of every so manieth probe."""
        for batch in batches:
            key = batch.column(0)
            both = np.stack(bloom_hashes(key), 1).astype("<u4")
            to = range(min(tasks, len(key)))
            held = pa.array([None] * len(to), pa.list_(key.type))
            if pairs:
                turn = [np.arange(i, len(key), tasks) for i in to]
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, turn)]), pa.int32()), key.take(pa.array(np.concatenate([[], *turn]), pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([None] * len(to), pa.list_(pa.int64())), pa.array([both[i::tasks].tobytes() for i in to], pa.binary()), held], ["task", "segments", "data", "keys"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First come the task's probes, then strips."""
        both, key, strips, wide = [], [], [], 0

        def tested() -> Iterator[pa.RecordBatch]:
            sides = np.concatenate([data for _, data in strips], 1)
            words = np.pad(sides, ((0, 0), (0, -sides.shape[1] % 8))).view("<u8")
            segments = np.array([s for ids, _ in strips for s in ids + [0] * (-len(ids) % 8)])  # no key passes where no segment is
            step, n = max(1, TESTED_WORDS // words.shape[1]), 0
            taken = np.empty((step, words.shape[1]), np.uint64)
            for i in range(0, len(both), step):
                at = bloom_positions(*both[i : i + step].T.astype(np.int64), bits, hashes)
                left = words[at[:, 0]]
                for j in range(1, hashes):
                    left &= np.take(words, at[:, j], 0, out=taken[: len(at)], mode="clip")
                if not pairs:
                    n += int(np.bitwise_count(left).sum(dtype=np.int64))
                elif left.any():
                    probe, of = np.nonzero(np.unpackbits(left.view(np.uint8), axis=1, bitorder="little"))
                    yield pa.RecordBatch.from_arrays([pa.array(segments[of]), key.take(pa.array(probe + i))], ["segment_id", "key"])
            if not pairs:
                yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

        for batch in batches:
            for ids, data, held in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                if not ids.is_valid:
                    both.append(np.frombuffer(data.as_py(), "<u4").reshape(-1, 2))
                    key += [held.values] if pairs else []
                    continue
                if isinstance(both, list):
                    if not both:
                        return
                    both, key = np.concatenate(both), pa.concat_arrays(key) if pairs else None
                strips.append((ids.as_py(), np.frombuffer(data.as_py(), np.uint8).reshape(-(-bits // 64) * 64, -1)))
                wide += strips[-1][1].shape[1] * 8
                if wide >= TESTED_FILTERS:
                    yield from tested()
                    strips, wide = [], 0
        if strips:
            yield from tested()

    schema = f"task int, segments array<bigint>, data binary, keys array<{kind}>"
    dealt = probes.select("key").where("key IS NOT NULL").distinct().mapInArrow(deal, schema)
    every = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    strips = _strips(filters, bits).select(every.alias("task"), "segments", "data", F.lit(None).cast(f"array<{kind}>").alias("keys"))
    met = dealt.union(strips).repartitionById(tasks, F.col("task")).sortWithinPartitions(F.col("segments").isNotNull())
    return met.mapInArrow(test, f"segment_id bigint, key {kind}" if pairs else "n bigint")


def bloom_may_contain(filters: DataFrame, probes: DataFrame, keys: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(segment_id, key) of probes that a segment's filter doesn't rule out: all of the key's bits are set."""
    return _pass(filters, probes, keys, bits_per_key, True)


def bloom_passes(filters: DataFrame, probes: DataFrame, keys: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(n): how many rows ``bloom_may_contain`` has, without making them."""
    return _pass(filters, probes, keys, bits_per_key, False).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def bloom_held(filters: DataFrame, log: DataFrame, keys: int, bits_per_key: int = BITS_PER_KEY, segment: str = "segment_id") -> DataFrame:
    """Distinct (segment_id, key) of the log that the filter of that segment doesn't rule out.  Nulls are in no filter, which rules nothing out.

    Tasks stream their segments, each one's filter and then its sorted keys; one filter is all that is held.
    """
    bits, hashes = bloom_shape(keys, bits_per_key)
    kind = log.schema["key"].dataType.simpleString()
    names = ["segment_id", "key"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, last, loose = np.zeros(-(-bits // 64), np.uint64), None, None, set()
        for batch in batches:
            odd = pc.or_(pc.is_null(batch.column(0)), pc.and_(pc.is_null(batch.column(1)), pc.is_null(batch.column(2))))
            if pc.any(odd).as_py():
                loose.update(zip(*(c.to_pylist() for c in batch.filter(odd).columns[:2]), strict=True))
                batch = batch.filter(pc.invert(odd))
            if not batch.num_rows:
                continue
            seg, key, is_key = batch.column(0).to_numpy(), batch.column(1), batch.column(2).is_null().to_numpy(False)
            word, mask = (batch.column(i).fill_null(0).to_numpy() for i in (2, 3))
            at = bloom_positions(*bloom_hashes(key), bits, hashes)
            fresh = np.concatenate([[True], seg[1:] != seg[:-1]])
            edges = [*np.flatnonzero(fresh).tolist(), len(seg)]
            fresh[1:] |= pc.fill_null(pc.not_equal(key[1:], key[:-1]), True).to_numpy(False)
            fresh[0] = last != (seg[0], key[0].as_py())
            last = seg[-1], key[-1].as_py()
            passed = np.zeros(len(seg), bool)
            for start, stop in zip(edges, edges[1:], strict=False):
                if now != seg[start]:
                    now, held[:] = seg[start], 0
                begin = start + int(np.count_nonzero(~is_key[start:stop]))
                held[word[start:begin]] = mask[start:begin].view(np.uint64)
                of = at[begin:stop]
                passed[begin:stop] = (held[of // 64] >> (of % 64).astype(np.uint64) & np.uint64(1)).all(1)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(passed & fresh)) for c in batch.columns[:2]], names)
        if loose:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*loose, strict=True), batch.columns, strict=False)], names)

    own = log.select(F.col(segment).cast("bigint").alias("segment_id"), "key", F.lit(None).cast("bigint").alias("word"), F.lit(None).cast("bigint").alias("bits"))
    met = filters.select("segment_id", F.lit(None).cast(kind).alias("key"), "word", "bits").union(own)
    # Filters' rows have no key, and so come first.
    return met.repartition("segment_id").sortWithinPartitions("segment_id", "key").mapInArrow(test, f"segment_id bigint, key {kind}")
