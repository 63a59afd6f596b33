"""How shards agree on keys, and merge runs of windows: a tree of nodes, at any number of shards.

Level 1 has a node for every group of ``fan`` shards and every one of ``fan`` buckets of keys; a node of level
k has ``fan`` nodes of the level below as children, and the keys of one of fan^k buckets.  The fan is ``FAN`` if
one level will do, else the least that reaches all shards at the depth that ``FAN`` needs, so that a level has
about as many nodes as there are shards.  Each child sends a
node every key once, so a node gets a row a child and at most a key a child, however often a key occurs in
the corpus.  The depth grows with the logarithm of the shards; a node's size doesn't grow at all.

What the children ask of a key is answered from the top down: for ``Shared`` the highest level at which two
children of one node have it (0: no other shard has it); for ``Naming`` the key's global name (0: it occurs
once in the corpus), a number that the top node gives to each distinct key.

Rows for nodes have negative targets, rows for shards their number; nodes leave rows for shards alone, so one
exchange can carry both.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import xxhash
import zstandard
from pyspark.sql import DataFrame

FAN = 256
COPY, KEYS, REPLY, MARKS, RUNS, STATE = range(6)
INFO = "target bigint, child bigint, kind tinyint, id bigint, h8 bigint, blob binary"
INFO_ARROW = pa.schema([("target", pa.int64()), ("child", pa.int64()), ("kind", pa.int8()), ("id", pa.int64()), ("h8", pa.int64()), ("blob", pa.binary())])


def mix(a: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (public splitmix64 constants)."""
    a = a ^ (a >> np.uint64(30))
    a = a * np.uint64(0xBF58476D1CE4E5B9)
    a ^= a >> np.uint64(27)
    a *= np.uint64(0x94D049BB133111EB)
    a ^= a >> np.uint64(31)
    return a


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def to_blob(*arrays: np.ndarray) -> bytes:
    """Arrays of any kinds; the bytes of a number lie apart, first bytes first, which packs better."""
    sizes = np.array([len(a) for a in arrays], "<i8").tobytes()
    body = (_planes(a) if a.itemsize > 1 and len(a) else a.tobytes() for a in arrays)
    return _PACK.compress(b"".join((sizes, *body)))


def _planes(a: np.ndarray) -> np.ndarray:
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1)
    out = np.empty(raw.shape[::-1], np.uint8)
    for k in range(len(out)):  # a transposition at once goes byte by byte
        out[k] = raw[:, k]
    return out


def from_blob(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = _UNPACK.decompress(blob)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)), kinds, strict=True):
        width = np.dtype(kind).itemsize
        flat = np.frombuffer(raw, np.uint8, n * width, at)
        if width > 1 and n:
            rows = np.empty((n, width), np.uint8)
            for k, plane in enumerate(flat.reshape(width, n)):
                rows[:, k] = plane
            flat = rows.ravel()
        out.append(flat.view(kind))
        at += n * width
    return out


def info_rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, INFO_ARROW, strict=True)], schema=INFO_ARROW)


def blobs(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(child, blob) of the rows of a kind, in the order of children."""
    some = table.filter(pa.compute.equal(table.column("kind"), kind))
    return sorted(zip(some.column("child").to_pylist(), some.column("blob").to_pylist(), strict=True))


def by_target(target: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(target, indexes) of each distinct target."""
    if not len(target):
        return []
    order = np.argsort(target, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(target[order])) + 1, [len(order)]])
    return [(int(target[order[a]]), order[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


class Tree(NamedTuple):
    """The shape of a tree, and the partitions of its exchanges."""

    fan: int
    depth: int
    parts: int

    @classmethod
    def over(cls, shards: int, parts: int, fan: int | None = None) -> Tree:
        fan, depth = fan or FAN, 1
        while fan**depth < shards:
            depth += 1
        # The top has fan^depth buckets, so the fan of several levels is no wider than they need: 257 shards of a fan of
        # 256 would have 65,536 top nodes, and 256 rows a shard and level.
        while depth > 1 and (fan - 1) ** depth >= shards:
            fan -= 1
        return cls(fan, depth, parts)

    def nodes(self, level: int, shard, hashes: np.ndarray) -> np.ndarray:
        """Targets of the nodes of a level that a shard's keys belong to; ``shard`` may be one or one for each key."""
        buckets = self.fan**level
        return -1 - (np.asarray(shard, np.int64) // buckets * buckets + (hashes % np.uint64(buckets)).astype(np.int64))

    def bucket(self, level: int, target: int) -> tuple[int, int]:
        """The first shard of a node's group, and its bucket."""
        buckets = self.fan**level
        return (-1 - target) // buckets * buckets, (-1 - target) % buckets

    def ask(self, codec, keys, twice: np.ndarray, child: int, shard: int, level: int = 1) -> list[tuple]:
        """Rows that send a child's distinct keys to the nodes of a level; ``twice``: those that occur twice in it."""
        return [(target, child, KEYS, None, None, codec.pack(codec.pick(keys, at), twice[at])) for target, at in by_target(self.nodes(level, shard, codec.hashes(keys)))]

    def answers(self, codec, keys, heard: pa.Table, shard: int, level: int = 1) -> np.ndarray:
        """For each key what its node replied; the keys are in the order in which they were sent."""
        out = np.zeros(len(keys), np.uint64)
        told = dict(blobs(heard, REPLY))
        for target, at in by_target(self.nodes(level, shard, codec.hashes(keys))):
            (out[at],) = from_blob(told[target], "<u8")
        return out

    def agree(self, rows: DataFrame, codec, rule) -> DataFrame:
        """Replies to the shards; ``rows`` are dealt by target, and may also have rows for shards."""
        levels = [rows]
        for level in range(1, self.depth):
            levels.append(levels[-1].groupBy("target").applyInArrow(_up(self, codec, level), INFO).repartition(self.parts, "target"))
        told = levels[-1].groupBy("target").applyInArrow(_top(self, codec, rule), INFO)
        for level in range(self.depth - 1, 0, -1):
            told = levels[level - 1].groupBy("target").cogroup(told.groupBy("target")).applyInArrow(_down(self, codec, rule, level), INFO)
        return told


class Numbers:
    """Keys of some columns of unsigned 64-bit numbers."""

    def __init__(self, width: int = 1):
        self.width = width

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys[:, 0] + np.uint64(0x9E3779B97F4A7C15))
        for k in range(1, self.width):
            h = mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + keys[:, k])
        return h

    def pick(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        return keys[at]

    def pack(self, keys: np.ndarray, twice: np.ndarray) -> bytes:
        return to_blob(twice.astype(np.uint8), *keys.T)

    def unpack(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        twice, *cols = from_blob(blob, "u1", *["<u8"] * self.width)
        return np.stack(cols, 1), twice.astype(bool)

    def unify(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of all lists, and each key's number among them."""
        return distinct_rows(np.concatenate(found))


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each distinct hash, and the number of each hash among them.

    Only upper bits are told apart, as the lower ones hold the index while sorting; callers compare what is hashed.
    """
    n = len(hashes)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    ordered = np.sort(hashes & ~low | np.arange(n, dtype=np.uint64))
    order = (ordered & low).astype(np.int64)
    ordered >>= bits
    fresh = np.ones(n, bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    return order[fresh], number


def distinct_rows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the number of each row among them."""
    if keys.shape[1] == 1:
        values, number = np.unique(keys[:, 0], return_inverse=True)
        return values[:, None], number
    first, number = numbered(Numbers(keys.shape[1]).hashes(keys))
    if all((col == col[first][number]).all() for col in np.ascontiguousarray(keys.T)):
        return keys[first], number
    order = np.lexsort(keys.T[::-1])
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (ordered[1:] != ordered[:-1]).any(1)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return ordered[fresh], number


#: By bytes, what of eight bytes is theirs.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def first_bytes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes of each stretch of the data and the next 8, as numbers; zeros beyond its end."""
    padded = np.zeros(len(data) + 24, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray(len(data) + 16, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    low, high = at[begin] & MASKS[np.minimum(size, 8)], np.zeros(len(begin), np.uint64)
    more = np.flatnonzero(size > 8)
    high[more] = at[begin[more] + 8] & MASKS[np.minimum(size[more] - 8, 8)]
    return low, high


class Words:
    """Keys of bytes without ASCII white space, compared as they are."""

    def of(self, words: list[bytes]) -> pa.Array:
        return pa.array(words, pa.large_binary())

    def parts(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each key ends in the data, after a zero; and the data."""
        if not len(keys):
            return np.zeros(1, np.int64), np.zeros(0, np.uint8)
        _, ends, data = keys.buffers()
        ends = np.frombuffer(ends, np.int64)[keys.offset : keys.offset + len(keys) + 1]
        return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]

    def hashes(self, keys: pa.Array) -> np.ndarray:
        ends, data = self.parts(keys)
        size = np.diff(ends)
        low, high = first_bytes(data, ends[:-1], size)
        out = mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + mix(high + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        long = np.flatnonzero(size > 16)
        out[long] = np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(ends[long].tolist(), ends[long + 1].tolist(), strict=True)), np.uint64, len(long))
        return out

    def pick(self, keys: pa.Array, at: np.ndarray) -> pa.Array:
        return keys.take(pa.array(at))

    def pack(self, keys: pa.Array, twice: np.ndarray) -> bytes:
        ends, data = self.parts(keys)
        text = np.full(len(data) + len(keys), 32, np.uint8)  # a space after each
        inside = np.ones(len(text), bool)
        inside[ends[1:] + np.arange(len(keys))] = False
        text[inside] = data
        return to_blob(twice.astype(np.uint8), text)

    def unpack(self, blob: bytes) -> tuple[pa.Array, np.ndarray]:
        twice, text = from_blob(blob, "u1", "u1")
        inside = text != 32
        ends = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(~inside) - np.arange(len(twice))])
        return pa.Array.from_buffers(pa.large_binary(), len(twice), [None, pa.py_buffer(ends), pa.py_buffer(text[inside])]), twice.astype(bool)

    def unify(self, found: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
        coded = pa.concat_arrays(found).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


class Shared:
    """Answers the highest level at which a key is in several children of a node."""

    def top(self, level: int, bucket: int, children: np.ndarray, twice: np.ndarray) -> np.ndarray:
        return np.where(children > 1, level, 0).astype(np.uint64)

    def down(self, level: int, above: np.ndarray, children: np.ndarray) -> np.ndarray:
        return np.maximum(above, np.where(children > 1, level, 0).astype(np.uint64))


class Naming:
    """Answers a name for each key that occurs twice; names of different rounds differ."""

    def __init__(self, number: int):
        self.number = number

    def top(self, level: int, bucket: int, children: np.ndarray, twice: np.ndarray) -> np.ndarray:
        if len(children) >= 1 << 24 or bucket >= 1 << 36:
            raise OverflowError("a node names less than 2^24 keys")
        names = np.arange(1, len(children) + 1, dtype=np.uint64) + np.uint64(self.number << 60 | bucket << 24)
        return np.where(twice | (children > 1), names, np.uint64(0))

    def down(self, level: int, above: np.ndarray, children: np.ndarray) -> np.ndarray:
        return above


def _gather(codec, table: pa.Table):
    """Children, how many keys each has, distinct keys, each sent key's number, children by key, whether it occurs twice."""
    rows = blobs(table, KEYS)
    sent = [codec.unpack(b) for _, b in rows]
    keys, at = codec.unify([k for k, _ in sent])
    twice = np.zeros(len(keys), bool)
    twice[at[np.concatenate([t for _, t in sent])]] = True
    return [c for c, _ in rows], [len(k) for k, _ in sent], keys, at, np.bincount(at, minlength=len(keys)), twice


def _replies(target: int, children: list[int], sizes: list[int], values: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    return info_rows([(c, target, REPLY, None, None, to_blob(values[e - n : e])) for c, n, e in zip(children, sizes, ends.tolist(), strict=True)])


def _up(tree: Tree, codec, level: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        target = key[0].as_py()
        if target >= 0:
            return info_rows([])
        _, _, keys, _, count, twice = _gather(codec, table)
        return info_rows(tree.ask(codec, keys, twice | (count > 1), target, tree.bucket(level, target)[0], level + 1))

    return run


def _top(tree: Tree, codec, rule) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        target = key[0].as_py()
        if target >= 0:
            return info_rows([])
        children, sizes, _, at, count, twice = _gather(codec, table)
        return _replies(target, children, sizes, rule.top(tree.depth, tree.bucket(tree.depth, target)[1], count, twice)[at])

    return run


def _down(tree: Tree, codec, rule, level: int) -> Callable:
    def run(key, table: pa.Table, heard: pa.Table) -> pa.Table:
        target = key[0].as_py()
        if target >= 0:
            return info_rows([])
        children, sizes, keys, at, count, _ = _gather(codec, table)
        above = tree.answers(codec, keys, heard, tree.bucket(level, target)[0], level + 1)
        return _replies(target, children, sizes, rule.down(level, above, count)[at])

    return run
