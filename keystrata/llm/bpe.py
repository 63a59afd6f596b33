"""Byte-level BPE encoding and decoding as a monoid tree reduction (operator 9).

A text is cut by the split pattern; each match is encoded on its own, so matches combine by plain
concatenation.  Inside a match, ``encode`` splits the bytes in halves, encodes them recursively and
joins the two token lists: the tokens around the seam are re-encoded in a window that grows until its
first and last tokens are again those that the halves had there.  That suffices: a token sequence is
*the* encoding exactly if every adjacent pair of tokens is (each pair re-encodes to itself), pairs left
and right of the window come from encodings, pairs inside it come from the window's own encoding, and
the two pairs at its rims are unchanged.  This needs a vocabulary in which every token re-encodes to
itself, which ``RankBPE.proper`` verifies.  Decoding concatenates the tokens' bytes.

Defined results: null text counts as empty (no tokens); empty text has ``n_tokens`` 0 and the hashes of
the empty string; equal rows get equal results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, map_slices, worker_memo

LEAF = 6  #: bytes that are merged directly; longer pieces are halved and joined
MEMO = 200_000  #: matches remembered in a worker, twice
FAR = 1 << 60


class RankBPE:
    """Byte-pair encoding by ranks; the id of a token is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        # Leaves and the narrowest windows recur in most words, so their encodings are remembered.
        self.leaves = Cache(lambda piece: tuple(self._scan(piece)))
        self.seams = Cache(lambda pair: tuple(self._scan(self.tokens[pair[0]] + self.tokens[pair[1]])))

    def _scan(self, piece: bytes) -> list[int]:
        """Direct merges, lowest rank first and leftmost among equals: for short pieces."""
        ranks, get = self.ranks, self.ranks.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [get(a + b, FAR) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == FAR:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], FAR)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], FAR)
        return [ranks[p] for p in parts]

    def _heap(self, piece: bytes) -> list[int]:
        """The same merges with a heap: for long windows."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the part that starts here; 0: merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            end[i], end[gone] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def direct(self, piece: bytes) -> list[int]:
        return self._scan(piece) if len(piece) <= 96 else self._heap(piece)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encoded byte strings one after the other."""
        if not left or not right:
            return left + right
        a = b = 1
        window = self.seams[left[-1], right[0]]
        while True:
            steady_left = a == len(left) or window[0] == left[-a]
            steady_right = b == len(right) or window[-1] == right[b - 1]
            if steady_left and steady_right:
                return left[:-a] + window + right[b:]
            if not steady_left:
                a = min(len(left), 2 * a + 1)
            if not steady_right:
                b = min(len(right), 2 * b + 1)
            window = tuple(self.direct(self.decode(left[-a:]) + self.decode(right[:b])))

    def reduce(self, piece: bytes) -> tuple[int, ...]:
        """The encoding by halves: leaves are merged directly, neighbours joined."""
        if len(piece) <= LEAF:
            return self.leaves[piece]
        half = len(piece) // 2
        return self.join(self.reduce(piece[:half]), self.reduce(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        return list(self.reduce(piece))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def proper(self) -> bool:
        """Whether each token is the encoding of its own bytes; joins need it."""
        return all(self.direct(k) == [v] for k, v in self.ranks.items())


@worker_memo(4)
def load_ranks(path: str) -> RankBPE:
    with open(path, "rb") as f:
        return RankBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class TextCoder:
    """Encodes and decodes texts; ids travel as decimal strings joined by commas."""

    def __init__(self, path: str, pattern: str):
        self.bpe = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.ids = Cache(lambda piece: ",".join(map(str, self.bpe.reduce(piece.encode()))), MEMO)
        self.bytes = Cache(lambda ids: self.bpe.decode(map(int, ids.split(","))), MEMO)

    def encode(self, text: str) -> list[str]:
        """The ids of each match of the pattern."""
        return list(map(self.ids.__getitem__, self.find(text)))

    def decode(self, encoded: list[str]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, encoded))


@worker_memo(4)
def text_coder(path: str, pattern: str) -> TextCoder:
    return TextCoder(path, pattern)


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the split pattern, as installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text: the operator's own output."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        coder = text_coder(path, pattern)
        ids = [list(map(int, ",".join(coder.encode(t)).split(","))) if t else [] for t in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_slices(source, "body", f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>", run)


def decode_texts(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, body binary): the bytes of each array of ids; null ids give null."""
    source = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches):
        for part in batches:
            bpe = load_ranks(path)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else bpe.decode(x) for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "body"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, body binary")


def token_digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes its ids and returns count and hashes of both."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        coder = text_coder(path, pattern)
        counts, ids, texts = [], [], []
        for body in part.column(1).to_pylist():
            encoded = coder.encode(body)
            listed = ",".join(encoded)
            counts.append(listed.count(",") + bool(listed))
            ids.append(hashlib.sha256(listed.encode()).hexdigest())
            texts.append(hashlib.sha256(coder.decode(encoded)).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(source, "body", SCHEMA, run)
