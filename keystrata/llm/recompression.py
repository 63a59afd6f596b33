"""Substring dedup by recompression: removes words of 13-word windows that an earlier document has (operator 7).

Recompression rounds rewrite every text as a shorter sequence of symbols.  Symbols are named by Spark over the
whole corpus (``tree``): first every word, by its bytes; then, in each of ``ROUNDS`` rounds, every maximal run of
one symbol and every pair of a left-side symbol followed by a right-side one (a symbol's side is drawn from its
name; such pairs cannot overlap).  The key of a name is what it stands for, so equal names are equal words.

A symbol notes which words its making depends on: its own and those of neighbours that decided it.  Equal
windows therefore contain the same symbols among those that depend on nothing outside.  A key that occurs once
in the corpus gets no name, and no window that holds such a symbol whole can have an equal: it is dropped, and
what no window covers leaves the sequence.  Words that are left after the rounds are almost only those of repeats.

At last each window selects its highest-level symbol (ties by hash, then leftmost; single words always
qualify).  Windows that share it at one place are compared word by word, in shards and up the tree of
``repeats``: by names of words, which are equal only if the words' bytes are.

Defined results: null texts have no words (kept_sha256 of nothing); texts under 13 words keep all; all
words of a copy of an earlier document go; windows that recur in one document only stay; repeated rows
(equal id and text) get equal results; of rows with equal id and different texts one counts as earlier, by
a hash of the text; null ids come first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats
from .common import bucketed, delete_path, shared_path
from .repeats import Docs, Removal, Runs, merged_rows, null_or, number_runs, spread
from .tree import INFO, STATE, Naming, Numbers, Tree, blobs, distinct_rows, first_bytes, from_blob, info_rows, mix, numbered, to_blob
from .tree import Words as WordKeys

WORDS, ROUNDS = 13, 3
#: Shards that a partition has about.
TOGETHER = 4
#: Words that are rewritten at once; bytes of a long text that are split at once.
BLOCK, CHUNK = 1 << 20, 1 << 20
FAR = 1 << 30
SPACE = re.compile(rb"[\x20\x09-\x0D]")
ONE = np.uint64(1 << 32 | 1)


def pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut between words into pieces of bounded size (one word at least)."""
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + CHUNK) if at + CHUNK < len(text) else None
        end = cut.start() if cut else len(text)
        yield text if end - at == len(text) else text[at:end]
        at = end


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Where each word begins, the distinct words, and each word's number among them.

    Words of up to 16 bytes are compared as two integers and a length, in numpy; longer ones as bytes.
    """
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 32, data - np.uint8(9) > 4, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    low, high = first_bytes(data, begin, size)
    long = np.flatnonzero(size > 16)
    seen: dict[bytes, int] = {}
    high[long] = [seen.setdefault(text[a:b], len(seen)) for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True)]
    low[long], kind = 0, np.minimum(size, 17).astype(np.uint64)
    first, number = numbered(mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + mix(high + kind * np.uint64(0x9E3779B97F4A7C15))))
    model = first[number]
    if ((low != low[model]) | (high != high[model]) | (kind != kind[model])).any():  # two words of one hash
        keys, number = distinct_rows(np.stack([low, high, kind], 1))
        first = np.full(len(keys), len(low))
        np.minimum.at(first, number, np.arange(len(low)))
    return begin, [text[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)], number


class State(NamedTuple):
    """Stretches of words that windows with possible equals cover, and their symbols; places are in the block."""

    id: np.ndarray  #: of a stretch: its document,
    h8: np.ndarray
    start: np.ndarray  #: its first word's number there,
    begin: np.ndarray  #: where it begins here, and the end
    word: np.ndarray  #: names of words
    name: np.ndarray  #: of the sequence's symbols, 0 if it occurs once
    at: np.ndarray  #: first word
    size: np.ndarray  #: words
    low: np.ndarray  #: first and last (exclusive) word that it depends on
    high: np.ndarray
    made: np.ndarray  #: names of all rounds' symbols inside the stretches,
    made_low: np.ndarray
    made_high: np.ndarray
    level: np.ndarray  #: their rounds


#: A dependence that reaches so many words beyond the symbol is beyond every window.
BEYOND = 200
PACKED = ("<i8", "<i8", "<i8", "<i4", "<u8", "u1", "<u8", "<i4", "<i4", "u1", "u1", "<u8", "<i4", "u1", "u1")


def pack(state: State, window: int) -> bytes:
    """A state as few bytes: of symbols that are single words the names are left out, and places are differences."""
    single = (state.size == 1) & (state.name == state.word[state.at])
    low = np.clip(state.at - state.low, 0, BEYOND)
    high = np.clip(state.high - state.at - state.size, 0, BEYOND)
    m = np.flatnonzero(state.made_high - state.made_low <= window)
    made_low, made_size = state.made_low[m], (state.made_high - state.made_low)[m]
    arrays = (state.id, state.h8, state.start, state.begin, state.word, np.packbits(single), state.name[~single], np.diff(state.at, prepend=0), state.size, low, high, state.made[m], np.diff(made_low, prepend=0), made_size, state.level[m])
    return to_blob(*(x.astype(k) for x, k in zip(arrays, PACKED, strict=True)))


def unpack(blob: bytes) -> State:
    ids, h8, start, begin, word, bits, names, at, size, low, high, made, made_low, made_size, level = from_blob(blob, *PACKED)
    at = np.cumsum(at, dtype=np.int64)
    single = np.unpackbits(bits, count=len(at)).astype(bool)
    name = word[at]
    name[~single] = names
    size, made_low = size.astype(np.int64), np.cumsum(made_low, dtype=np.int64)
    return State(ids, h8, start, begin.astype(np.int64), word, name, at, size, np.where(low < BEYOND, at - low, -FAR), np.where(high < BEYOND, at + size + high, FAR), made, made_low, made_low + made_size, level)


def cut(state: State, window: int) -> State:
    """What is covered by windows that hold no nameless symbol."""
    n = len(state.word)
    if not n:
        return state
    dead = np.zeros(n + 1, np.int64)
    i = np.flatnonzero((state.name == 0) & (state.low >= 0) & (state.high <= n) & (state.high - state.low <= window))
    np.add.at(dead, np.maximum(state.high[i] - window, 0), 1)
    np.add.at(dead, state.low[i] + 1, -1)
    alive = np.cumsum(dead[:-1]) == 0
    size = np.diff(state.begin)
    alive[spread(np.maximum(state.begin[1:] - window + 1, state.begin[:-1]), np.minimum(size, window - 1))] = False
    s = np.flatnonzero(alive)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + window, -1)
    covered = np.flatnonzero(np.cumsum(edge[:-1]))
    stretch = np.searchsorted(state.begin, covered, "right") - 1
    head, length = number_runs(covered, stretch)
    first, old = covered[head], stretch[head]
    begin = np.concatenate([[0], np.cumsum(length)])
    # New places; what leaves has -FAR, or FAR where it ends a range.
    place = np.full(n + 1, -FAR, np.int64)
    place[covered] = np.arange(len(covered))
    number = np.full(n, -1, np.int64)
    number[covered] = np.repeat(np.arange(len(head)), length)

    def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside, ends = (low >= 0) & (low < n), (high > 0) & (high <= n)
        new_low, new_high = np.full(len(low), -FAR), np.full(len(low), FAR)
        new_low[inside] = place[low[inside]]
        new_high[ends] = np.where(place[high[ends] - 1] >= 0, place[high[ends] - 1] + 1, FAR)
        return new_low, new_high

    k = np.flatnonzero((number[state.at] >= 0) & (number[state.at] == number[state.at + state.size - 1]))
    low, high = ranges(state.low[k].astype(np.int64), state.high[k].astype(np.int64))
    made_low, made_high = ranges(state.made_low.astype(np.int64), state.made_high.astype(np.int64))
    m = np.flatnonzero((made_low >= 0) & (made_high <= len(covered)) & (made_high - made_low == state.made_high - state.made_low))
    return State(state.id[old], state.h8[old], state.start[old] + first - state.begin[old], begin, state.word[covered], state.name[k], place[state.at[k]], state.size[k], low, high, state.made[m], made_low[m], made_high[m], state.level[m])


class Step(NamedTuple):
    """A round's new sequence before its symbols are named."""

    keys: np.ndarray  #: what the new symbols stand for: (left name, right name or 0, how often each)
    new: np.ndarray  #: which elements are new symbols
    name: np.ndarray  #: of the others
    at: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray


def rewrite(state: State, level: int) -> Step:
    """Runs of one symbol, then pairs of a left-side one and a right-side one."""
    name, at, size, low, high = state.name, state.at, state.size, state.low, state.high
    stretch = np.searchsorted(state.begin, at, "right")
    # Runs. That a run is maximal depends on the symbols around it; at a stretch's rim, on what isn't there.
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (stretch[1:] != stretch[:-1]) | (name[1:] == 0)
    first = np.flatnonzero(fresh)
    times = np.diff(np.append(first, len(name)))
    last = first + times - 1
    joined = np.zeros(len(first) + 1, bool)  # whether run k follows run k - 1 in one stretch
    joined[1:-1] = stretch[first[1:]] == stretch[first[:-1]]
    run_low = np.minimum(np.where(joined[:-1], low[np.maximum(first - 1, 0)], -FAR), low[first])
    run_high = np.maximum(np.where(joined[1:], high[np.minimum(last + 1, len(name) - 1)], FAR), high[last])
    name, size, at = name[first], at[last] + size[last] - at[first], at[first]
    long, known = times > 1, name > 0
    # Pairs. A symbol that finds no partner depends on the neighbour that isn't one.
    right = mix(name * np.uint64(0xC2B2AE3D27D4EB4F) + times.astype(np.uint64) + np.uint64(level << 40)) >> np.uint64(63) == 1
    follows = joined[1:-1]
    lead = np.zeros(len(name), bool)
    lead[:-1] = ~right[:-1] & right[1:] & follows & known[:-1] & known[1:]
    tail = np.zeros(len(name), bool)
    tail[1:] = lead[:-1]
    before, after = np.append(False, follows), np.append(follows, False)
    new_low, new_high = run_low.copy(), run_high.copy()
    lone = ~lead & ~tail
    i = np.flatnonzero(lone & (right | ~known))
    new_low[i] = np.where(before[i], np.minimum(run_low[i], run_low[np.maximum(i - 1, 0)]), -FAR)
    i = np.flatnonzero(lone & (~right | ~known))
    new_high[i] = np.where(after[i], np.maximum(run_high[i], run_high[np.minimum(i + 1, len(name) - 1)]), FAR)
    i = np.flatnonzero(lead)
    new_low[i], new_high[i] = np.minimum(run_low[i], run_low[i + 1]), np.maximum(run_high[i], run_high[i + 1])
    size = size.copy()
    size[i] += size[i + 1]
    new = lead | (long & lone)
    k = np.flatnonzero(new)
    partner = np.minimum(k + 1, len(name) - 1)
    keys = np.stack([name[k], np.where(lead[k], name[partner], 0), times[k].astype(np.uint64) << np.uint64(32) | np.where(lead[k], times[partner], 0).astype(np.uint64)], 1)
    keep = ~tail
    # A symbol that occurs once needs only its own words to be so.
    still = (name == 0) & lone
    new_low[still], new_high[still] = low[first[still]], high[first[still]]
    return Step(keys, new[keep], name[keep], at[keep], size[keep], new_low[keep], new_high[keep])


def named(state: State, step: Step, names: np.ndarray, level: int) -> State:
    """The state after a round, given the names of its new symbols."""
    name = step.name.copy()
    name[step.new] = names
    i = np.flatnonzero(step.new)
    known = i[names > 0]
    return state._replace(
        name=name, at=step.at, size=step.size, low=step.low, high=step.high,
        made=np.concatenate([state.made, name[known]]), made_low=np.concatenate([state.made_low, step.low[known]]), made_high=np.concatenate([state.made_high, step.high[known]]), level=np.concatenate([state.level, np.full(len(known), level, np.uint8)]),
    )


def first_state(ids: np.ndarray, h8: np.ndarray, start: np.ndarray, lengths: np.ndarray, names: np.ndarray) -> State:
    """Texts, or parts of long ones, as sequences of words."""
    n, none = len(names), np.zeros(0, np.int64)
    return State(ids, h8, start, np.concatenate([[0], np.cumsum(lengths)]), names, names, np.arange(n), np.ones(n, np.int64), np.arange(n), np.arange(1, n + 1), none.astype(np.uint64), none, none, none.astype(np.uint8))


class Words:
    """The word method for ``repeats``."""

    within_document, payload = False, "<u8"

    def __init__(self, length: int = WORDS, rounds: int = ROUNDS):
        self.window, self.rounds, self.block = length, rounds, BLOCK
        self.steps = list(range(length))

    def words(self, payload: np.ndarray) -> np.ndarray:
        return payload

    def runs(self, state: State, shard: int, depth: int) -> Runs:
        """The state's windows, each with the symbol that it selects."""
        n = len(state.word)
        name = np.concatenate([state.word, state.made])
        low, high = np.concatenate([np.arange(n), state.made_low]), np.concatenate([np.arange(1, n + 1), state.made_high])
        level = np.concatenate([np.zeros(n, np.uint64), state.level.astype(np.uint64)])
        rank = level << np.uint64(61) | (mix(name) >> np.uint64(35)) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(name)).astype(np.uint64))
        size = high - low
        best = [np.zeros(n, np.uint64) for _ in range(self.window + 1)]
        for k in range(1, self.window + 1):
            i = np.flatnonzero(size == k)
            np.maximum.at(best[k], low[i], rank[i])
        chosen = best[1]
        for wider in best[2:]:  # chosen[i]: the best symbol inside the k words from i on
            np.maximum(wider, chosen, out=wider)
            wider[:-1] = np.maximum(wider[:-1], chosen[1:])
            chosen = wider
        symbol = (np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)
        counts = np.maximum(np.diff(state.begin) - self.window + 1, 0)
        at, stretch = spread(state.begin[:-1], counts), np.repeat(np.arange(len(counts)), counts)
        head, size = number_runs(at, symbol[at], stretch)
        first, s, j = at[head], symbol[at[head]], stretch[head]
        units = state.word[spread(first, size + self.window - 1)]
        return Runs(name[s], np.full(len(first), depth, np.uint64), np.full(len(first), shard), state.id[j], state.h8[j], state.start[j] + first - state.begin[j], (low[s] - first).astype(np.int16), size.astype(np.int32), units)


class Vocabulary(NamedTuple):
    """A shard's distinct words, and its texts as numbers of them."""

    words: list[bytes]
    codes: list[np.ndarray]  #: of each document


def read_words(docs: Docs) -> Vocabulary:
    vocabulary, known, out, held, size = [], {}, [], [], 0

    def close() -> None:
        begin, words, codes = word_numbers(b"\n".join(part for _, part in held))
        if vocabulary:  # only a shard of very long texts is read in several goes
            if not known:
                known.update(zip(vocabulary, range(len(vocabulary)), strict=True))
            codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))[codes]
            vocabulary.extend(list(known)[len(vocabulary) :])
        else:
            vocabulary.extend(words)
        for (d, _), part in zip(held, np.split(codes.astype(np.uint32), np.searchsorted(begin, np.cumsum([len(part) + 1 for _, part in held])[:-1])), strict=True):
            out[d].append(part)
        held.clear()

    for d, text in enumerate(docs.texts()):
        out.append([])
        for part in pieces(text):
            if size + len(part) > 8 * CHUNK and held:
                close()
                size = 0
            held.append((d, part))
            size += len(part)
    if held:
        close()
    return Vocabulary(vocabulary, [parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint32)]) for parts in out])


def report_words(tree: Tree) -> Callable:
    """A shard's distinct words, for the nodes."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return info_rows([])
        shard, read = key[0].as_py(), read_words(Docs(left, right))
        if not read.words:
            return info_rows([])
        times = sum((np.bincount(c, minlength=len(read.words)) for c in read.codes), np.zeros(len(read.words), np.int64))
        return info_rows(tree.ask(WordKeys(), WordKeys().of(read.words), times > 1, shard, shard))

    return run


def state_rows(states: list[State], window: int, shard: int) -> list[tuple]:
    return [(shard, b, STATE, None, None, pack(s, window)) for b, s in enumerate(states)]


def report_keys(tree: Tree, level: int) -> Callable:
    """A round's distinct keys of a shard, for the nodes."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        keys, times = round_keys([unpack(b) for _, b in blobs(rows, STATE)], level)
        return info_rows(tree.ask(Numbers(3), keys, times > 1, key[0].as_py(), key[0].as_py()))

    return run


def round_keys(states: list[State], level: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the new symbols of a round, and how often each occurs."""
    keys, number = distinct_rows(np.concatenate([np.zeros((0, 3), np.uint64), *(rewrite(s, level).keys for s in states)]))
    return keys, np.bincount(number, minlength=len(keys))


def start_states(tree: Tree, method: Words) -> Callable:
    """Texts become sequences of named words; those of windows with a word that occurs once are left out."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return info_rows([])
        shard, docs = key[0].as_py(), Docs(left, right)
        read = read_words(docs)
        if not read.words:
            return info_rows([])
        names, states, held, size = tree.answers(WordKeys(), WordKeys().of(read.words), right, shard), [], [], 0

        def close() -> None:
            made = first_state(*(np.array(x, np.int64) for x in zip(*((docs.ids[d], docs.h8[d], at, len(part)) for d, at, part in held), strict=True)), names[np.concatenate([part for *_, part in held])])
            if len((made := cut(made, method.window)).word):
                states.append(made)
            held.clear()

        for d, codes in enumerate(read.codes):
            for at in range(0, len(codes) - method.window + 1, method.block):  # parts of a long text overlap, so that each window is in one
                part = codes[at : at + method.block + method.window - 1]
                if held and size + len(part) > method.block:
                    close()
                    size = 0
                held.append((d, at, part))
                size += len(part)
        if held:
            close()
        return info_rows(state_rows(states, method.window, shard))

    return run


def finished(tree: Tree, method: Words, states: list[State], shard: int) -> list[tuple]:
    """A shard's marks, and the runs for the nodes."""
    runs = [method.runs(s, shard, tree.depth) for s in states]
    child = np.repeat(np.arange(len(runs)), [len(r.n) for r in runs])
    return merged_rows(tree, method, Runs.joined(runs), child, shard, 0) if len(child) else []


def next_states(tree: Tree, method: Words, level: int) -> Callable:
    """A round's names are put in; after the last round, windows are compared."""

    def run(key, rows: pa.Table, heard: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return info_rows([])
        shard = key[0].as_py()
        states = [unpack(b) for _, b in blobs(rows, STATE)]
        steps = [rewrite(s, level) for s in states]
        keys, number = distinct_rows(np.concatenate([np.zeros((0, 3), np.uint64), *(s.keys for s in steps)]))
        names = tree.answers(Numbers(3), keys, heard, shard)[number]
        ends = np.cumsum([len(s.keys) for s in steps]).tolist()
        states = [cut(named(s, step, names[end - len(step.keys) : end], level), method.window) for s, step, end in zip(states, steps, ends, strict=True)]
        states = [s for s in states if len(s.word)]
        return info_rows(finished(tree, method, states, shard) if level == method.rounds else state_rows(states, method.window, shard))

    return run


def remove_repeats(docs: DataFrame, method: Words, apply: Callable[[Removal, pa.Table], pa.Table], schema) -> DataFrame:
    """Each round is a job of its own: its names are checkpointed, its states a table that the next but one deletes."""
    dealt, spark = repeats.deal(docs, together=TOGETHER), docs.sparkSession
    tree = dealt.tree
    told = tree.agree(dealt.step(report_words(tree)).repartition(tree.parts, "target"), WordKeys(), Naming(0)).checkpoint()
    where = shared_path(spark, "state")
    states = bucketed(dealt.step(start_states(tree, method), told), "target", tree.parts, where)
    for level in range(1, method.rounds + 1):
        asked = states.groupBy("target").applyInArrow(report_keys(tree, level), INFO).repartition(tree.parts, "target")
        told = tree.agree(asked, Numbers(3), Naming(level)).checkpoint()
        rows = states.groupBy("target").cogroup(told.groupBy("target")).applyInArrow(next_states(tree, method, level), INFO)
        if level < method.rounds:
            before, where = where, shared_path(spark, "state")
            states = bucketed(rows, "target", tree.parts, where)
            delete_path(spark, before)
    marks = repeats.merge_tree(rows.repartition(tree.parts, "target"), method, tree).checkpoint()
    delete_path(spark, where)
    return repeats.finish(dealt, method, marks, apply, schema)


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def _left(body: bytes, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, those left) of each chunk of a text."""
    at = 0
    for words in map(bytes.split, pieces(body)):
        n, out, done = len(words), [], 0
        for a, b in zip(begin[(a := np.searchsorted(end, at, "right")) : (z := np.searchsorted(begin, at + n))].tolist(), end[a:z].tolist(), strict=True):
            out += words[done : max(a - at, done)]
            done = min(b - at, n)
        yield n, out + words[done:] if done or out else words
        at += n


def _results(removal: Removal, rows: pa.Table) -> Iterator[tuple]:
    """(id, words, removed words, parts of the text left) of each row."""
    for doc_id, h8, body in zip(*(rows.column(c).to_pylist() for c in ("ks_id", "ks_h8", "ks_body")), strict=True):
        copy = (doc_id, h8) in removal.copies
        n, parts, left = 0, [], 0
        for size, words in _left(body, *(repeats.NOTHING if copy else removal.of(doc_id, h8, 0))):
            n += size
            left += len(words)
            if words:
                parts.append(b" ".join(words))
        if copy and n >= removal.window:
            parts, left = [], 0
        yield null_or(doc_id, h8), n, n - left, parts


def _digest(removal: Removal, rows: pa.Table) -> pa.Table:
    out = [(key, n, gone, hashlib.sha256(b" ".join(parts)).hexdigest()) for key, n, gone, parts in _results(removal, rows)]
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def _texts(removal: Removal, rows: pa.Table) -> pa.Table:
    out = [(key, b" ".join(parts).decode()) for key, _, _, parts in _results(removal, rows)]
    cols = list(zip(*out, strict=True)) or [()] * 2
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string()), strict=True)], names=["doc_id", "text"])


def dedup_digest(docs: DataFrame, length: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """Per document: its words, removed words and the hash of the words left."""
    return remove_repeats(docs.select("doc_id", "text"), Words(length, rounds), _digest, SCHEMA)


def dedup_texts(docs: DataFrame, length: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text) of every document: the words left, joined by single spaces."""
    return remove_repeats(docs.select("doc_id", "text"), Words(length, rounds), _texts, "doc_id bigint, text string")
