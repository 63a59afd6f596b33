"""Suffix-array dedup: removes bytes of 100-byte strings that start earlier (operator 2).

The dataflow is that of ``repeats``; the method here is for bytes.  A window's anchor is its 24-byte string
of least hash (77 of them start in a window).  A shard's candidate passages form one byte sequence whose
suffixes are sorted by Larsson-Sadakane refinement in numpy: first by 8 bytes, then groups that are still
undecided by the rank of the suffix 8, 16, 32, 64 bytes on.  Common prefixes of neighbours come from
Kasai's theorem: along the text a common prefix shrinks by one a step as long as the neighbour moves along,
so only the first of each such stretch is compared.  Suffixes with 100 bytes in common are one class.
Shards merge in a tree: one shard's sorted suffixes (those whose anchor both have) are looked up in another's
by binary search that compares their bytes.

Defined results: null and empty texts have no bytes (kept_sha256 of nothing); texts under 100 bytes keep
all; all of a copy of an earlier document goes; repeated rows (equal id and text) get equal results;
rows with equal id and different texts are ordered by a hash of the text; null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats
from .repeats import Docs, Removal, Runs, mark_rows, merged_rows, null_or, number_runs, run_rows, spread
from .tree import Numbers, Shared, Tree, info_rows, mix

LENGTH, GRAM = 100, 24
#: Bytes of text that are sorted at once.
BLOCK = 4 << 20


def words8(data: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The 8 bytes from each position on as an integer; zeros beyond the end."""
    n = len(data)
    padded = np.zeros(-(-n // 8) * 8 + 16, np.uint8)
    padded[:n] = data
    out = np.empty(len(padded) - 8, kind)
    for k in range(8):
        part = padded[k : k + (len(padded) - 8) // 8 * 8].view(kind)
        out[k::8] = part
    return out[:n]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on (positions near the end: of what is there and zeros)."""
    w = words8(data)
    padded = np.concatenate([w, np.zeros(16, w.dtype)])
    h = w * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += padded[8 : 8 + len(w)]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h += padded[16 : 16 + len(w)]
    return mix(h)


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` bytes (8 times a power of 2), and their ranks.

    A suffix's rank is the place of its group's first; groups of one are decided and not sorted again.
    """
    n = len(data)
    keys = words8(data, ">u8").astype(np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.ones(n, bool)
    fresh[1:] = keys[1:] != keys[:-1]
    del keys
    array = order.astype(np.int32)
    del order
    place = np.arange(n, dtype=np.int32)
    head = np.maximum.accumulate(np.where(fresh, place, 0))
    rank = np.empty(n, np.int32)
    rank[array] = head
    alone = fresh & np.append(fresh[1:], True)
    active = place[~alone]
    h = 8
    while h < depth and len(active):
        s = array[active].astype(np.int64)
        ahead = s + h
        key = rank[s].astype(np.int64) << 32
        inside = ahead < n
        key[inside] |= rank[ahead[inside]].astype(np.int64) + 1
        order = np.argsort(key)
        key = key[order]
        array[active] = s[order]
        fresh = np.ones(len(active), bool)
        fresh[1:] = key[1:] != key[:-1]
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(active)), 0))
        rank[array[active]] = active[head]
        alone = fresh & np.append(fresh[1:], True)
        active = active[~alone]
        h *= 2
    return array, rank


def common_prefixes(data: np.ndarray, array: np.ndarray, limit: int) -> np.ndarray:
    """Bytes (limit at most) that each suffix of the array has in common with the one before it."""
    n = len(data)
    before = np.full(n, -1, np.int32)  # in the order of the text
    before[array[1:]] = array[:-1]
    position = np.arange(n, dtype=np.int64)
    moved = np.zeros(n, bool)
    moved[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (data[:-1] == data[np.maximum(before[:-1], 0)])
    # Stretches are cut every few steps, as a capped length says nothing about the steps beyond it.
    block = position % 64 == 0
    heads = np.flatnonzero(~moved | block)
    w = words8(data)
    length = np.zeros(len(heads), np.int64)
    reach = limit + 64
    live = np.flatnonzero(before[heads] >= 0)
    d = 0
    while len(live) and d < reach:
        a, b = heads[live] + d, before[heads[live]].astype(np.int64) + d
        inside = (a < n) & (b < n)
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        differ = w[a] ^ w[b]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        same = np.where(inside, np.minimum(same, n - np.maximum(a, b)), 0)
        length[live] += same
        live = live[same == 8]
        d += 8
    size = np.diff(np.append(heads, n))
    along = np.maximum(np.repeat(length, size) - (position - np.repeat(heads, size)), 0)
    along[before < 0] = 0
    return np.minimum(along, limit)[array]


class Block(NamedTuple):
    """Texts, or parts of long ones, end to end."""

    units: np.ndarray
    starts: np.ndarray  #: where each begins, and the end
    doc: np.ndarray  #: number of its document in the shard
    offset: np.ndarray  #: its place in its document

    @classmethod
    def of(cls, parts: list[tuple[int, int, bytes]]) -> Block:
        starts = np.concatenate([[0], np.cumsum([len(p[2]) for p in parts])]).astype(np.int64)
        return cls(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), starts, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))


def blocks_of(docs: Docs, window: int, block: int):
    """Blocks of the texts that have windows; parts of a text overlap, so that each window is in one of them."""
    held, size = [], 0
    for d, text in enumerate(docs.texts()):
        for at in range(0, len(text) - window + 1, block):
            part = text[at : at + block + window - 1]
            if held and size + len(part) > block:
                yield Block.of(held)
                held, size = [], 0
            held.append((d, at, part))
            size += len(part)
    if held:
        yield Block.of(held)


class Bytes:
    """The byte method for ``repeats``."""

    within_document, payload = True, "u1"

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.window, self.gram, self.block = length, gram, BLOCK
        self.steps = [*range(0, length - 8, 8), length - 8]

    def words(self, payload: np.ndarray) -> np.ndarray:
        return words8(payload, ">u8").astype(np.uint64)

    def anchors(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position: the place of the anchor that its window selects; hashes by place."""
        hashes = gram_hashes(units)
        n, width = len(units), self.window - self.gram + 1
        least = hashes & np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(n, dtype=np.uint64)
        have = 1
        while have * 2 <= width:  # least[i]: the least of `have` grams from i on, leftmost among equals
            least[: n - have] = np.minimum(least[: n - have], least[have:])
            have *= 2
        if (rest := width - have) and n > rest:
            least[: n - rest] = np.minimum(least[: n - rest], least[rest:])
        return (least & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes

    def runs(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first window, windows, name and place of the anchor) of each run of windows with one anchor."""
        counts = np.diff(block.starts) - self.window + 1
        places, names = self.anchors(block.units)
        at = spread(block.starts[:-1], counts)
        chosen = places[at]
        first, n = number_runs(at, chosen, np.repeat(np.arange(len(counts), dtype=np.int32), counts))
        return at[first], n, names[chosen[first]], chosen[first]

    def classes(self, units: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Numbers from 0 of equal windows, given their starts, ascending."""
        # Passages: stretches of bytes that the windows cover, end to end, in the order of the text.
        head, n = number_runs(windows)
        begin, end = windows[head], windows[head] + n - 1 + self.window
        near = np.flatnonzero(begin[1:] > end[:-1]) + 1
        begin, end = begin[np.concatenate([[0], near])], end[np.concatenate([near - 1, [len(end) - 1]])]
        size = end - begin
        passages = units[spread(begin, size)]
        k = np.searchsorted(begin, windows, "right") - 1
        local = windows - begin[k] + (np.cumsum(size) - size)[k]
        depth = 8
        while depth < self.window:
            depth *= 2
        array, _ = suffix_array(passages, depth)
        common = common_prefixes(passages, array, self.window)
        classes = np.empty(len(passages), np.int64)
        classes[array] = np.cumsum(common < self.window)
        return np.unique(classes[local], return_inverse=True)[1]


def report_anchors(tree: Tree, method: Bytes) -> Callable:
    """A shard's distinct anchors, for the nodes."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return info_rows([])
        shard = key[0].as_py()
        names = [np.unique(method.runs(b)[2]) for b in blocks_of(Docs(left, right), method.window, method.block)]
        if not names:
            return info_rows([])
        keys = np.unique(np.concatenate(names))[:, None]
        return info_rows(tree.ask(Numbers(), keys, np.zeros(len(keys), bool), shard, shard))

    return run


def resolve_shard(tree: Tree, method: Bytes) -> Callable:
    """A shard's marks, and the runs that other shards may have too."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return info_rows([])
        shard, docs = key[0].as_py(), Docs(left, right)
        found = [(b, *method.runs(b)) for b in blocks_of(docs, method.window, method.block)]
        if not found:
            return info_rows([])
        keys, blocks = np.unique(np.concatenate([np.unique(f[3]) for f in found]), return_counts=True)
        levels = tree.answers(Numbers(), keys[:, None], right, shard)
        out, sent, child = [], [], []
        for k, (block, low, n, name, place) in enumerate(found):
            known = np.searchsorted(keys, name)
            level, elsewhere = levels[known], (levels[known] > 0) | (blocks[known] > 1)
            _, which, times = np.unique(name, return_inverse=True, return_counts=True)
            keep = elsewhere | (times[which] > 1)
            low, n, name, place, level, elsewhere = (x[keep] for x in (low, n, name, place, level, elsewhere))
            if not len(low):
                continue
            windows, run_of = spread(low, n), np.repeat(np.arange(len(low)), n)
            classes = method.classes(block.units, windows)
            first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, classes, windows)
            repeated = windows > first[classes]
            part = lambda at: np.searchsorted(block.starts, at, "right") - 1  # noqa: B023, E731
            at = windows[repeated]
            head, size = number_runs(at, part(at))
            p = part(at[head])
            out += mark_rows(np.full(len(head), shard), docs.ids[block.doc[p]], docs.h8[block.doc[p]], at[head] - block.starts[p] + block.offset[p], size)
            send = elsewhere & (np.bincount(run_of, ~repeated, minlength=len(low)) > 0)
            low, n, name, place, level = (x[send] for x in (low, n, name, place, level))
            if len(low):
                p = part(low)
                sent.append(Runs(name, level, np.full(len(low), shard), docs.ids[block.doc[p]], docs.h8[block.doc[p]], low - block.starts[p] + block.offset[p], (place - low).astype(np.int16), n.astype(np.int32), block.units[spread(low, n + method.window - 1)]))
                child.append(np.full(len(low), k))
        if len(sent) > 1:
            out += merged_rows(tree, method, Runs.joined(sent), np.concatenate(child), shard, 0)
        elif sent:
            out += run_rows(tree, sent[0].pick(np.flatnonzero(sent[0].level > 0), method.window), shard, 1, method.window)
        return info_rows(out)

    return run


def remove_repeats(docs: DataFrame, method: Bytes, apply: Callable[[Removal, pa.Table], pa.Table], schema, carry: list[Column] | None = None) -> DataFrame:
    dealt = repeats.deal(docs, carry)
    tree = dealt.tree
    asked = dealt.step(report_anchors(tree, method)).repartition(tree.parts, "target")
    resolved = dealt.step(resolve_shard(tree, method), tree.agree(asked, Numbers(), Shared())).repartition(tree.parts, "target")
    return repeats.finish(dealt, method, repeats.merge_tree(resolved, method, tree).checkpoint(), apply, schema)


SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def kept_parts(body: bytes, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """What is left of a text."""
    return [body[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(body)], strict=True) if b > a]


def _digest(removal: Removal, rows: pa.Table) -> pa.Table:
    out = []
    for doc_id, h8, body in zip(*(rows.column(c).to_pylist() for c in ("ks_id", "ks_h8", "ks_body")), strict=True):
        begin, end = removal.of(doc_id, h8, len(body))
        left = hashlib.sha256()
        for part in kept_parts(body, begin, end):
            left.update(part)
        out.append((null_or(doc_id, h8), len(body), int((end - begin).sum()), len(begin), left.hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def dedup_digest(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: its bytes, removed bytes, maximal removed runs, and the hash of the bytes left."""
    return remove_repeats(docs.select("doc_id", "text"), Bytes(length, gram), _digest, SCHEMA)


def whole_characters(body: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals without characters that are only in part inside them."""

    def start(at: int, step: int) -> int:
        while 0 < at < len(body) and body[at] & 0xC0 == 0x80:
            at += step
        return at

    begin, end = np.array([start(a, 1) for a in begin.tolist()], np.int64), np.array([start(b, -1) for b in end.tolist()], np.int64)
    return begin[begin < end], end[begin < end]


def keep_first(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """All rows and columns, the text without repeated bytes; ``n_chars``, if there, is the new text's.

    A character goes only if all of its bytes do, so texts stay valid UTF-8.  Null texts stay null, empty ones
    empty; copies of earlier documents get an empty text if they have ``length`` bytes, else keep theirs.
    """
    names = docs.columns
    others = [c for c in names if c not in ("text", "n_chars")]
    # The other columns travel in one struct, so none of their names can clash.
    rest = F.struct(F.lit(0), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others))).alias("ks_rest")
    missing = F.col("text").isNull().alias("ks_missing")

    def rewrite(removal: Removal, rows: pa.Table) -> pa.Table:
        texts = []
        for doc_id, h8, body, gone in zip(*(rows.column(c).to_pylist() for c in ("ks_id", "ks_h8", "ks_body", "ks_missing")), strict=True):
            spans = removal.of(doc_id, h8, len(body))
            left = b"".join(kept_parts(body, *whole_characters(body, *spans))) if len(spans[0]) else body
            texts.append(None if gone else left.decode())
        return pa.Table.from_arrays([rows.column("ks_rest"), pa.array(texts, pa.string())], names=["ks_rest", "text"])

    shape = docs.select(rest, "text").schema
    out = remove_repeats(docs, Bytes(length, gram), rewrite, shape, [rest, missing])
    back = {c: F.col("ks_rest").getField(f"c{k}").alias(c) for k, c in enumerate(others)}
    back |= {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")} if "n_chars" in names else {})
    return out.select(*(back[c] for c in names))
