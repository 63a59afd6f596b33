"""The dataflow that both exact-repeat operators share (operators 2 and 7).

A window is a fixed number of consecutive units (bytes or words) of one document.  The task is to find
every window that also starts earlier, over all documents, without comparing documents in pairs:

1. Tasks pack the documents that they read into shards of some MB, compressed, and write them as a table in
   buckets: no text is ever exchanged, and every later step reads the table.  Equal texts are found by hash: only
   the first of them takes part, the others are repeats as a whole.
2. Every window selects an anchor inside itself by its content alone, so equal windows select equal anchors
   at equal offsets.  Shards learn over the tree of nodes (``tree``) which anchors other shards have as well.
3. A shard marks all but the first of its own equal windows, and sends the runs of windows that are first in
   it and whose anchor others have to the tree's nodes.
4. A node merges its children's runs: each child's windows are sorted by (anchor, offset, content), and one
   child's are looked up in another's by binary search that compares contents; children merge in pairs, and
   pairs of pairs.  All but the first of equal windows are marked; what is first goes up to the next level.
5. Marks go to the shards of their documents, which apply them.

A window that half of all documents hold is one entry a shard from step 3 on and one a node further up, so hot
passages and groups of copies never meet in one task unreduced.  A text beyond ``BLOCK`` units is handled a
block at a time, with blocks that overlap by a window.  Nothing is sampled or capped; anchors only decide which
windows are compared.

Documents are ordered by (id, hash of text), null ids first; rows with equal id and text are one document
and get equal results.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bucketed, lean, shared_path, slices, trim
from .tree import COPY, INFO, MARKS, RUNS, Tree, blobs, by_target, from_blob, info_rows, mix, to_blob

SHARD_BYTES = 4 << 20
#: Partitions of the exchanges at most.  Shards and nodes are handled one by one, so a partition can hold many.
MAX_PARTITIONS = 20_000
NULL_ID = -(1 << 63)
SIGN = -(1 << 63)
#: Groups of copies above this share of all rows are joined in several tasks; there can be so many of them at most.
HOT_GROUPS = 1000
RUN_KINDS, MARK_KINDS = ("<u8", "<u8", "<i8", "<i8", "<i8", "<i8", "<i2", "<i4"), ("<i8", "<i8", "<i8", "<i8")


def spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] of them), starts[1], ..."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + n, n)


def number_runs(at: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the maximal runs of consecutive positions with equal companions."""
    if not len(at):
        return at, at
    cut = np.diff(at) != 1
    for s in same:
        cut |= s[1:] != s[:-1]
    first = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return first, np.diff(np.append(first, len(at)))


class Method(Protocol):
    """What differs between the operators."""

    window: int
    within_document: bool  #: whether an earlier start in the same document counts
    payload: str  #: dtype of the units that a run of windows carries
    steps: list[int]  #: places in a window whose ``words`` hold it whole

    def words(self, payload: np.ndarray) -> np.ndarray:
        """For each place a number; windows compare as the numbers at their steps do."""


class Runs(NamedTuple):
    """Windows that follow each other in a document and select one anchor; parallel arrays but for the payload."""

    name: np.ndarray  #: of the anchor
    level: np.ndarray  #: of the tree's highest node that has the anchor from several children
    shard: np.ndarray
    id: np.ndarray
    h8: np.ndarray
    low: np.ndarray  #: the first window's start in its document
    off: np.ndarray  #: the anchor's place in the first window
    n: np.ndarray  #: windows
    payload: np.ndarray  #: units of all runs, n + window - 1 of each

    def begins(self, window: int) -> np.ndarray:
        size = self.n.astype(np.int64) + window - 1
        return np.cumsum(size) - size

    def pick(self, at: np.ndarray, window: int) -> Runs:
        units = spread(self.begins(window)[at], self.n[at].astype(np.int64) + window - 1)
        return Runs(*(x[at] for x in self[:-1]), self.payload[units])

    def pack(self) -> bytes:
        head = [x.astype(k) for x, k in zip(self[:-1], RUN_KINDS, strict=True)]
        if self.payload.itemsize == 1:
            return to_blob(*head, self.payload)
        # Units that are numbers: those that occur, the most frequent ones first, and each unit's place among them.
        units, number, times = np.unique(self.payload, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), "<u4")
        place[order] = np.arange(len(order))
        return to_blob(*head, units[order], place[number])

    @classmethod
    def unpack(cls, blob: bytes, payload: str) -> Runs:
        if np.dtype(payload).itemsize == 1:
            return cls(*from_blob(blob, *RUN_KINDS, payload))
        *head, units, place = from_blob(blob, *RUN_KINDS, payload, "<u4")
        return cls(*head, units[place])

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def ranks(ids: np.ndarray, h8: np.ndarray) -> np.ndarray:
    """Numbers of documents in their order."""
    order = np.lexsort((h8, ids))
    fresh = np.ones(len(ids), np.int64)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (h8[order][1:] != h8[order][:-1])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def compare(words: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[int]) -> np.ndarray:
    """-1, 0 or 1 as the window at a is below, equal to or above the one at b."""
    out, live = np.zeros(len(a), np.int8), np.arange(len(a))
    for d in steps:
        x, y = words[a[live] + d], words[b[live] + d]
        differ = x != y
        if differ.any():
            out[live[differ]] = np.where(x[differ] < y[differ], -1, 1)
            live = live[~differ]
            if not len(live):
                break
    return out


def equal_windows(tag: np.ndarray, at: np.ndarray, child: np.ndarray, words: np.ndarray, steps: list[int]) -> np.ndarray:
    """A number for each window, equal for those with equal tag and content, over all children.

    Each child's windows are sorted; then children merge in pairs: the windows of one are searched in the
    sorted windows of the other, and those that are not there are put in their places.
    """
    order = np.lexsort((tag, child))
    t, c = tag[order], child[order]
    tied = np.zeros(len(order), bool)
    tied[1:] = (t[1:] == t[:-1]) & (c[1:] == c[:-1])
    tied[:-1] |= tied[1:]
    some = np.flatnonzero(tied)
    root = np.arange(len(tag))
    fresh = np.ones(len(order), bool)
    if len(some):  # a child's windows of one tag are in the order of their contents
        group = np.cumsum(np.append(True, (t[some][1:] != t[some][:-1]) | (c[some][1:] != c[some][:-1])))
        places = at[order[some]]
        sorted_ = None
        if c[0] == c[-1]:  # of one child only it matters which are equal: a hash sorts them, if it tells them apart
            hashes = mix(group.astype(np.uint64))
            for d in steps:
                hashes = mix(hashes ^ words[places + d])
            sorted_ = np.argsort(hashes, kind="stable")
            near, there = places[sorted_], hashes[sorted_]
            equal = there[1:] == there[:-1]
            k = np.flatnonzero(equal)
            if (group[sorted_[k + 1]] != group[sorted_[k]]).any() or compare(words, near[k + 1], near[k], steps).any():
                sorted_ = None
        if sorted_ is None:
            sorted_ = np.lexsort((*(words[places + d] for d in reversed(steps)), group))
            near = places[sorted_]
            equal = (group[sorted_][1:] == group[sorted_][:-1]) & (compare(words, near[1:], near[:-1], steps) == 0)
        order[some] = order[some][sorted_]
        first = np.maximum.accumulate(np.where(np.append(True, ~equal), np.arange(len(some)), 0))
        root[order[some]] = order[some[first]]
        fresh[some[1:][equal]] = False
    order = order[fresh]
    leaves = np.split(order, np.flatnonzero(np.diff(child[order])) + 1)
    while len(leaves) > 1:
        merged = []
        for k in range(0, len(leaves) - 1, 2):
            big, small = sorted(leaves[k : k + 2], key=len, reverse=True)
            low, high = np.searchsorted(tag[big], tag[small]), np.searchsorted(tag[big], tag[small], "right")
            found = np.full(len(small), -1)
            live = np.flatnonzero(low < high)
            while len(live):
                middle = (low[live] + high[live]) // 2
                side = compare(words, at[big[middle]], at[small[live]], steps)
                found[live[side == 0]] = middle[side == 0]
                low[live[side < 0]] = middle[side < 0] + 1
                high[live[side > 0]] = middle[side > 0]
                live = live[(side != 0) & (low[live] < high[live])]
            new = found < 0
            root[small[~new]] = big[found[~new]]
            merged.append(np.insert(big, low[new], small[new]))
        leaves = merged + leaves[len(leaves) // 2 * 2 :]
    while (root[root] != root).any():
        root = root[root]
    return root


def merge_runs(method: Method, runs: Runs, child: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """(run, first window, windows) of the repeats among the children's runs; runs that have windows which are first."""
    window, count = method.window, len(runs.n)
    n, begin, words = runs.n.astype(np.int64), runs.begins(method.window), method.words(runs.payload)
    rank = ranks(runs.id, runs.h8)
    first = rank << 32 | runs.low if method.within_document else rank  # of the first window; the others' follow
    # Runs that are equal as a whole: all windows repeat those of the least.
    last = begin + n - 1
    print_ = mix(runs.name + runs.n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + runs.off.astype(np.uint64))
    for d in method.steps:
        print_ = mix(print_ ^ words[begin + d]) + words[last + d]
    order = np.lexsort((first, print_))
    head = np.maximum.accumulate(np.where(np.append(True, print_[order][1:] != print_[order][:-1]), np.arange(count), 0))
    model = np.empty(count, np.int64)
    model[order] = order[head]
    same = (runs.name == runs.name[model]) & (n == n[model]) & (runs.off == runs.off[model])
    for k in range(0, int(n.max(initial=0)) + window, window):  # windows end to end, and the last, hold a run whole
        at = np.minimum(k, n - 1)
        live = np.flatnonzero(same)
        same[live] = compare(words, begin[live] + at[live], begin[model[live]] + at[live], method.steps) == 0
    gone = same & (first > first[model])

    left = np.flatnonzero(~gone)
    _, which, times = np.unique(runs.name[left], return_inverse=True, return_counts=True)
    left = left[times[which] > 1]
    run = np.repeat(left, n[left])
    k = spread(np.zeros(len(left), np.int64), n[left])
    tag = mix(runs.name[run] + (runs.off[run] - k).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    root = equal_windows(tag, begin[run] + k, child[run], words, method.steps)
    place = first[run] + k if method.within_document else first[run]
    least = np.full(len(run), np.iinfo(np.int64).max)
    np.minimum.at(least, root, place)
    repeated = place > least[root]
    firsts = ~gone
    firsts[left] = np.bincount(run, ~repeated, minlength=count)[left] > 0
    hit = np.flatnonzero(repeated)
    at, size = number_runs(k[hit], run[hit])
    found = np.concatenate([np.flatnonzero(gone), run[hit[at]]]), np.concatenate([np.zeros(gone.sum(), np.int64), k[hit[at]]]), np.concatenate([n[gone], size])
    return found, firsts


class Docs:
    """The distinct documents of a shard that take part, in order."""

    def __init__(self, left: pa.Table, right: pa.Table):
        ids, hashes = left.column("ks_id").to_numpy(), left.column("ks_h8").to_numpy()
        copies = right.filter(pa.compute.equal(right.column("kind"), COPY))
        gone = set(zip(copies.column("id").to_pylist(), copies.column("h8").to_pylist(), strict=True))
        order = np.lexsort((hashes, ids))
        order = [k for j, k in enumerate(order) if (j == 0 or (ids[k], hashes[k]) != (ids[order[j - 1]], hashes[order[j - 1]])) and (int(ids[k]), int(hashes[k])) not in gone]
        self.ids, self.h8, self.bodies, self.order = ids[order], hashes[order], left.column("ks_body"), order

    def texts(self):
        """Each document's text, one at a time."""
        return (self.bodies[int(k)].as_py() for k in self.order)


def mark_rows(runs_shard: np.ndarray, ids: np.ndarray, h8: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[tuple]:
    return [(s, None, MARKS, None, None, to_blob(*(x[i].astype(np.int64) for x in (ids, h8, start, n)))) for s, i in by_target(runs_shard)]


def run_rows(tree: Tree, runs: Runs, child: int, level: int, window: int) -> list[tuple]:
    """Rows that send runs to the nodes of a level."""
    targets = tree.nodes(level, runs.shard, mix(runs.name + np.uint64(0x9E3779B97F4A7C15)))
    return [(target, child, RUNS, None, None, runs.pick(at, window).pack()) for target, at in by_target(targets)]


def merged_rows(tree: Tree, method: Method, runs: Runs, child: np.ndarray, sender: int, level: int) -> list[tuple]:
    """What a shard (level 0) or node makes of its children's runs: marks, and the runs that go up."""
    (run, k, n), firsts = merge_runs(method, runs, child)
    out = mark_rows(runs.shard[run], runs.id[run], runs.h8[run], runs.low[run] + k, n)
    up = np.flatnonzero(firsts & (runs.level > level))
    return out + run_rows(tree, runs.pick(up, method.window), sender, level + 1, method.window) if len(up) else out


def merge_node(tree: Tree, method: Method, level: int) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        target = key[0].as_py()
        if target >= 0:  # marks, on their way to a shard
            return table
        parts = [Runs.unpack(b, method.payload) for _, b in blobs(table, RUNS)]
        child = np.repeat(np.arange(len(parts)), [len(p.n) for p in parts])
        out = info_rows(merged_rows(tree, method, Runs.joined(parts), child, target, level))
        trim()
        return out

    return run


def merge_tree(rows: DataFrame, method: Method, tree: Tree) -> DataFrame:
    """All marks for the shards; ``rows``, dealt by target, have the shards' own marks and their runs."""
    for level in range(1, tree.depth + 1):
        rows = rows.groupBy("target").applyInArrow(merge_node(tree, method, level), INFO)
        if level < tree.depth:
            rows = rows.repartition(tree.parts, "target")
    return rows


class Removal:
    """What is repeated in a shard's documents: merged intervals of units; all of a copy."""

    def __init__(self, method: Method, right: pa.Table):
        self.window = method.window
        copies = right.filter(pa.compute.equal(right.column("kind"), COPY))
        self.copies = set(zip(copies.column("id").to_pylist(), copies.column("h8").to_pylist(), strict=True))
        found = [from_blob(b, *MARK_KINDS) for b in right.filter(pa.compute.equal(right.column("kind"), MARKS)).column("blob").to_pylist()]
        self.spans: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if found:
            ids, h8, start, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, h8, ids))
            ids, h8, start, end = ids[order], h8[order], start[order], (start + n + self.window - 1)[order]
            doc = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (h8[1:] != h8[:-1])))
            reach = np.maximum.accumulate(end + (doc << 40)) - (doc << 40)
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(ids)) - 1
            heads = np.flatnonzero(np.append(True, np.diff(doc[first]) != 0))
            for a, b in zip(heads, np.append(heads[1:], len(first)), strict=True):
                self.spans[int(ids[first[a]]), int(h8[first[a]])] = start[first[a:b]], reach[last[a:b]]

    def of(self, doc_id: int, h8: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of what goes from a document of ``size`` units."""
        if (doc_id, h8) in self.copies:
            return (np.zeros(1, np.int64), np.full(1, size)) if size >= self.window else NOTHING
        return self.spans.get((doc_id, h8), NOTHING)


NOTHING = np.zeros(0, np.int64), np.zeros(0, np.int64)


def null_or(doc_id: int, h8: int) -> int | None:
    """The id of a row."""
    return None if doc_id == NULL_ID and h8 < 0 else doc_id


def unpack(left: pa.Table, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(b).read_all().cast(schema) for b in left.column("blob").to_pylist())])


class Dealt(NamedTuple):
    """The texts in their shards, their copies, and the tree over the shards."""

    shards: DataFrame  #: target, blob: a shard's ks_id, ks_h8, ks_body and what is carried; in buckets by target
    copies: DataFrame  #: rows of kind COPY
    tree: Tree
    schema: pa.Schema  #: of a shard

    def step(self, fn: Callable, rows: DataFrame | None = None, schema=INFO) -> DataFrame:
        """``fn`` of each shard: its texts, and its copies and other rows."""
        told, kind = self.copies if rows is None else self.copies.union(rows), self.schema

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            lean(fn.__module__)
            out = fn(key, unpack(left, kind), right)
            trim()
            return out

        return self.shards.select("target", "blob").groupBy("target").cogroup(told.groupBy("target")).applyInArrow(run, schema)


PACKED = "target bigint, ids array<bigint>, hashes array<bigint>, keys array<binary>, blob binary"


def packer(tasks: int, size: int) -> Callable:
    """Rows of a task as shards of ``size`` bytes of text; numbers of shards are dense if there are ``tasks`` tasks."""

    def run(batches):
        from pyspark import TaskContext

        part, k, held, so_far = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, (kept := rows.drop_columns(["ks_key"])).schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as f:
                f.write_table(kept.combine_chunks())
            cols = [pa.array([[*rows.column(c).to_pylist()]], t) for c, t in (("ks_id", pa.list_(pa.int64())), ("ks_h8", pa.list_(pa.int64())), ("ks_key", pa.list_(pa.binary())))]
            return pa.RecordBatch.from_arrays([pa.array([k * tasks + part], pa.int64()), *cols, pa.array([out.getvalue().to_pybytes()], pa.binary())], ["target", "ids", "hashes", "keys", "blob"])

        for batch in slices(batches, 2, max(1, size // 8)):
            held.append(batch)
            so_far += pa.compute.sum(pa.compute.binary_length(batch.column(2))).as_py()
            if so_far >= size:
                yield row()
                k, held, so_far = k + 1, [], 0
        if held:
            yield row()
        held.clear()
        trim()

    return run


def deal(docs: DataFrame, carry: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text", together: int = 1) -> Dealt:
    """Shards hold each text once, and of the other columns only what ``carry`` asks for.

    A partition has about ``together`` shards, one after the other: an exchange has as many blocks as the square of the partitions.

    A null id travels as the least bigint with a negative hash; a real one of that value has another.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    row = docs.select(F.length(body).alias("n"), F.spark_partition_id().alias("part")).agg(F.sum("n").alias("size"), F.count("*").alias("n"), F.max("part").alias("last")).first()
    parts = min(MAX_PARTITIONS, max(-(-(row["size"] or 0) // (SHARD_BYTES * together)), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key, h = F.col(id_col).cast("bigint"), F.xxhash64(body)
    h8 = F.when(key.isNull(), h.bitwiseOR(F.lit(SIGN))).when(key == NULL_ID, h.bitwiseAND(F.lit(~SIGN))).otherwise(h)
    named = docs.select(F.coalesce(key, F.lit(NULL_ID)).alias("ks_id"), h8.alias("ks_h8"), body.alias("ks_body"), *(carry or []), F.substring(F.unhex(F.sha2(body, 256)), 1, 16).alias("ks_key"))
    shards = bucketed(named.mapInArrow(packer((row["last"] or 0) + 1, SHARD_BYTES), PACKED), "target", parts, shared_path(spark, "dealt"))

    keys = shards.select("target", F.explode(F.arrays_zip("ids", "hashes", "keys")).alias("r")).select("target", F.col("r.ids").alias("ks_id"), F.col("r.hashes").alias("ks_h8"), F.col("r.keys").alias("ks_key"))
    groups = keys.groupBy("ks_key").agg(F.min(F.struct("ks_id", "ks_h8")).alias("ks_first"), F.count("*").alias("ks_n")).where("ks_n > 1")
    # A group of copies may be a third of all rows.  Those over `hot` rows, HOT_GROUPS at most, meet their first in several tasks.
    hot = max(100, row["n"] // HOT_GROUPS)
    salts = (F.col("ks_n") / hot).cast("int") + 1
    few = F.broadcast(groups.where(F.col("ks_n") > hot).select("ks_key", salts.alias("ks_salts")))
    salted = keys.join(few, "ks_key", "left").withColumn("ks_salt", F.pmod(F.xxhash64("ks_id", F.lit("salt")), F.coalesce("ks_salts", F.lit(1))).cast("int"))
    firsts = groups.select("ks_key", "ks_first", F.explode(F.sequence(F.lit(0), F.when(F.col("ks_n") > hot, salts - 1).otherwise(0))).alias("ks_salt"))
    nothing = lambda kind: F.lit(None).cast(kind)
    later = salted.join(firsts, ["ks_key", "ks_salt"]).where(F.struct("ks_id", "ks_h8") > F.col("ks_first"))
    copies = later.select("target", nothing("bigint").alias("child"), F.lit(COPY).cast("tinyint").alias("kind"), F.col("ks_id").alias("id"), F.col("ks_h8").alias("h8"), nothing("binary").alias("blob"))
    last = shards.agg(F.max("target")).first()[0] or 0
    schema = to_arrow_schema(named.drop("ks_key").schema)
    return Dealt(shards, copies.checkpoint(), Tree.over(last + 1, parts), schema)


def finish(dealt: Dealt, method: Method, marks: DataFrame, apply: Callable[[Removal, pa.Table], pa.Table], schema) -> DataFrame:
    """``apply`` of every shard: its removals and its rows (ks_id, ks_h8, ks_body and what is carried)."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return apply(Removal(method, right), left)

    return dealt.step(run, marks, schema)
