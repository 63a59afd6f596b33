"""Benchmark decontamination by training suffix arrays (operator 3).

Words are runs of ASCII digits, letters (lower-cased) and non-ASCII characters.  Each slice of documents
(a shard) is one sequence of word numbers with a stop between documents; its suffix array holds the
suffixes that can match at all: those whose first words, as many as the shortest window has, all occur in
the benchmark.  Every distinct benchmark window (8 words, or the whole of a shorter item) is looked up by
binary search, one word of depth at a time, which gives its places.  For the longest verbatim match of a
document, every place of it is looked up the same way in the suffix array of the benchmark, which holds
every suffix of every item; a match may be of any length, also shorter than a window.

The benchmark is a stated query set: it is read in blocks of ``BLOCK_BYTES`` of text, each one broadcast.  A
narrow pass over the documents takes ``BLOCKS`` blocks one after the other, in one worker a task; a larger
benchmark takes more passes, with what was found so far checkpointed between them.  No document is shuffled.

Defined results: null or empty texts have no words; items without words and rows with null item_id have
no windows; repeated item_ids count as one item, repeated documents get equal results; an empty benchmark
hits nothing; other columns of either table are ignored.  ``remove_contaminated`` drops every document that
holds a window of any item (``contaminated`` of the digest asks for two items); repeated rows stay or go alike.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_slices, shared_dir

WINDOW, CONTAMINATED = 8, 2
BLOCK_BYTES, BLOCKS = 4 << 20, 8
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def known_places(sequence: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Suffixes that begin with ``least`` words, ordered by their first ``depth``."""
    n = len(sequence)
    padded = np.concatenate([sequence, np.zeros(depth + 1, sequence.dtype)])
    stops = np.flatnonzero(sequence == 0)
    following = np.append(stops, n)[np.searchsorted(stops, np.arange(n))] if n else np.zeros(0, np.int64)
    places = np.flatnonzero(following - np.arange(n) >= least)
    group = np.zeros(len(places), np.int64)
    for d in range(0, depth, 2):  # refine the groups by two more words, until each is one suffix
        key = padded[places + d] << 32 | padded[places + d + 1]
        order = np.lexsort((key, group))
        places, group, key = places[order], group[order], key[order]
        fresh = np.ones(len(places), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(fresh)
        if fresh.all():
            break
    return places


def all_places(sequence: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes that begin with a word, ordered by their first ``depth``; each round doubles the words compared."""
    rank, width = sequence + 1, 1
    while True:
        key = rank << 32 | np.concatenate([rank[width:], np.zeros(min(width, len(rank)), np.int64)])
        values, rank = np.unique(key, return_inverse=True)
        rank, width = rank + 1, 2 * width
        if width >= depth or len(values) == len(rank):
            break
    order = np.argsort(rank, kind="stable")
    return order[sequence[order] > 0]


class SuffixArray:
    """Sorted suffixes of a sequence of word numbers (0: no word of the benchmark, or a stop).

    An interval of it narrows by one word at a time: inside it the next word is sorted, so two binary
    searches find the part that has the test's next word.
    """

    def __init__(self, sequence: np.ndarray, places: np.ndarray):
        self.padded = np.concatenate([sequence, np.zeros(2, sequence.dtype)])
        self.places = places
        self.pairs = self.padded[places] << 32 | self.padded[places + 1]

    def windows(self, test: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of the test: the array's interval that matches it."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.places), np.int64)
        first, last = low.copy(), low.copy()
        live, d = np.flatnonzero(high > low), 0
        while len(live):
            a, b = self._narrow(low[live], high[live], d, test[starts[live] + d])
            live, a, b = live[b > a], a[b > a], b[b > a]
            low[live], high[live] = a, b
            d += 1
            whole = lengths[live] == d
            first[live[whole]], last[live[whole]] = a[whole], b[whole]
            live = live[~whole]
        return first, last

    def longest(self, test: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each suffix of the test, which must begin with a word of the array: the words of its longest match."""
        size = np.ones(len(starts), np.int64)
        if not len(self.places):
            return size
        padded = np.append(test, [0, 0])
        pair = padded[starts] << 32 | padded[starts + 1]
        low = np.searchsorted(self.pairs, pair)
        live = np.flatnonzero((padded[starts + 1] > 0) & (self.pairs[np.minimum(low, len(self.pairs) - 1)] == pair))
        low, high, d = low[live], np.searchsorted(self.pairs, pair[live], "right"), 2
        while len(live):
            size[live] = d
            word = padded[starts[live] + d]
            on = word > 0
            live, low, high = live[on], low[on], high[on]
            a, b = self._narrow(low, high, d, word[on])
            on = b > a
            live, low, high = live[on], a[on], b[on]
            d += 1
        return size

    def _narrow(self, low: np.ndarray, high: np.ndarray, d: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self._bisect(low, high, d, word)
        return a, self._bisect(a, high, d, word + 1)

    def _bisect(self, low: np.ndarray, high: np.ndarray, d: int, word: np.ndarray) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = self.padded[np.minimum(self.places[np.minimum(middle, len(self.places) - 1)] + d, len(self.padded) - 1)] < word
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low


class Block(NamedTuple):
    """Some benchmark items: numbered words, the items end to end (0 between), and the windows."""

    vocabulary: dict[bytes, int]
    sequence: np.ndarray
    starts: np.ndarray  #: of a window in the sequence, one for each distinct window
    lengths: np.ndarray  #: of these windows
    item_rows: np.ndarray  #: items with the k-th window: item_of[item_rows[k]:item_rows[k + 1]]
    item_of: np.ndarray
    names: list[str]  #: item ids as text
    array: SuffixArray  #: of the sequence, all suffixes


def make_block(items: list[tuple[object, bytes]]) -> Block:
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    sequence, windows = [0], {}
    for name, text in items:
        numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        k = names.setdefault(str(name), len(names))
        size = min(WINDOW, len(numbers))
        for i in range(len(numbers) - size + 1 if size else 0):
            windows.setdefault(tuple(numbers[i : i + size]), (len(sequence) + i, set()))[1].add(k)
        sequence += [*numbers, 0]
    found = list(windows.items())
    owners = [sorted(w[1][1]) for w in found]
    numbered = np.array(sequence, np.int64)
    array = SuffixArray(numbered, all_places(numbered, int(np.diff(np.flatnonzero(numbered == 0)).max(initial=1))))
    return Block(vocabulary, numbered, np.array([w[1][0] for w in found], np.int64), np.array([len(w[0]) for w in found], np.int64), np.array([0, *accumulate(map(len, owners))], np.int64), np.array([k for o in owners for k in o], np.int64), list(names), array)


class Hits(NamedTuple):
    n_words: int
    mask: np.ndarray  #: of words
    items: set[str]
    longest: int
    longest_at: int | None


def match(texts: list[bytes | None], block: Block, longest_too: bool = True) -> list[Hits]:
    """The block's matches in a shard of texts; the longest are 0 unless asked for."""
    get, numbers, begins = block.vocabulary.get, [0], []
    for text in texts:
        begins.append(len(numbers))
        numbers += [get(w, 0) for w in words(text)]
        numbers.append(0)
    begins.append(len(numbers))
    sequence, starts = np.array(numbers, np.int64), np.array(begins, np.int64)
    mask, items = np.zeros(len(numbers), bool), [set() for _ in texts]
    longest, longest_at = np.zeros(len(texts), np.int64), np.full(len(texts), -1, np.int64)
    if len(block.starts):
        array = SuffixArray(sequence, known_places(sequence, int(block.lengths.min()), int(block.lengths.max())))
        first, last = array.windows(block.sequence, block.starts, block.lengths)
        found = np.flatnonzero(last > first)
        if len(found):
            times = last[found] - first[found]
            at = array.places[np.repeat(first[found] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            window = np.repeat(found, times)
            edge = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + block.lengths[window], -1)
            mask = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(starts, at, "right") - 1
            for d, w in np.unique(np.stack([doc, window], 1), axis=0):
                items[d].update(block.names[k] for k in block.item_of[block.item_rows[w] : block.item_rows[w + 1]])
    if longest_too and texts:
        known = np.flatnonzero(sequence)
        size = np.zeros(len(numbers), np.int64)
        size[known] = block.array.longest(sequence, known)
        longest = np.maximum.reduceat(size, starts[:-1])
        top = np.flatnonzero((size > 0) & (size == np.append(0, np.repeat(longest, np.diff(starts)))))
        doc, at = np.unique(np.searchsorted(starts, top, "right") - 1, return_index=True)
        longest_at[doc] = top[at] - starts[doc]
    return [Hits(int(e - s - 1), mask[s : e - 1], items[k], int(longest[k]), int(longest_at[k]) if longest[k] else None) for k, (s, e) in enumerate(zip(begins, begins[1:]))]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", limit: int = BLOCK_BYTES) -> list:
    """Broadcasts of the benchmark's blocks; the driver holds one block of text at a time."""
    spark, out, held, size = benchmark.sparkSession, [], [], 0
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body")).where(F.col("id").isNotNull() & F.col("body").isNotNull())
    for r in rows.toLocalIterator():
        held.append((r.id, bytes(r.body)))
        size += len(r.body)
        if size >= limit:
            out.append(spark.sparkContext.broadcast(make_block(held)))
            held, size = [], 0
    if held or not out:
        out.append(spark.sparkContext.broadcast(make_block(held)))
    return out


def _free(taken: list[str], name: str) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _state(docs: DataFrame, text_col: str, shared: list, longest_too: bool = True) -> tuple[DataFrame, str]:
    """All columns of docs and one more, a struct of what the blocks so far found."""
    name = _free(docs.columns, "hits")
    kind = "struct<n_words: bigint, mask: binary, items: array<string>, longest: bigint, longest_at: bigint>"
    state = docs.withColumn(name, F.lit(None).cast(kind))
    at, text_at = len(docs.columns), docs.columns.index(text_col)
    out = pa.struct([("n_words", pa.int64()), ("mask", pa.binary()), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())])

    def stage(some):
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t.encode() if isinstance(t, str) else t for t in part.column(text_at).to_pylist()]
            rows = part.column(at).to_pylist()
            for block in some:
                rows = [_join(old, hits) for old, hits in zip(rows, match(texts, block.value, longest_too), strict=True)]
            return pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(rows, out)], part.schema.names)

        return run

    for k in range(0, len(shared), BLOCKS):
        if k:
            shared_dir(docs.sparkSession)
            state = state.checkpoint()
        state = map_slices(state, text_col, state.schema, stage(shared[k : k + BLOCKS]))
    return state, name


def _join(old: dict | None, hits: Hits) -> dict:
    """What earlier blocks found in a document, and this one."""
    row = {"n_words": hits.n_words, "mask": np.packbits(hits.mask).tobytes(), "items": sorted(hits.items), "longest": hits.longest, "longest_at": hits.longest_at}
    if old:
        row["mask"] = (np.frombuffer(row["mask"], np.uint8) | np.frombuffer(old["mask"], np.uint8)).tobytes()
        row["items"] = sorted({*row["items"], *old["items"]})
        if (old["longest"], -(old["longest_at"] or 0)) >= (hits.longest, -(hits.longest_at or 0)):
            row |= {"longest": old["longest"], "longest_at": old["longest_at"]}
    return row


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of words, of hit words, the sorted item ids, the longest verbatim match and its place."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    state, hits = _state(source, "body", blocks(benchmark))
    return state.select("doc_id", F.col(f"{hits}.n_words").alias("n_words"), _ones(F.col(f"{hits}.mask")).alias("n_hit"), F.col(f"{hits}.items").alias("items"), F.col(f"{hits}.longest").alias("longest_match"), F.col(f"{hits}.longest_at").alias("longest_at"))


def _ones(mask: Column) -> Column:
    """Set bits: hexadecimal digits by their number of ones."""
    text = F.hex(mask)
    total = F.lit(0).cast("bigint")
    for ones, digits in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        total = total + ones * (F.length(text) - F.length(F.translate(text, digits, "")))
    return total


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("items") >= CONTAMINATED).alias("contaminated"), "longest_match", "longest_at")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without any item's window, unchanged."""
    state, hits = _state(docs, text_col, blocks(benchmark), longest_too=False)
    return state.where(F.size(f"{hits}.items") == 0).drop(hits)
