"""Token-ID / binary output: one zstandard frame per document with a shared dictionary (operator 6).

Format of a shard (all integers little-endian)::

    magic "KTS1" | u8 bytes per id | 3 zero bytes | u64 documents | 16 bytes dictionary hash
    frames, one per document, in ascending id order
    index: per document  i64 id, u8 id is null, u64 frame offset, u64 tokens
    u64 offset of the index | "KTSX"

A store is a folder with ``dictionary`` (the trained dictionary and its hash, one row), ``shards``
(one row per shard: number, ids, tokens, image) and ``starts`` (ids before each shard).  The images are cells of Parquet files that Spark's
writer commits, so a store can live wherever Spark can write and survives lost or repeated tasks.
A document is read by its index entry alone: seek, take one frame, decompress with the dictionary whose
hash the shard names.

Defined results: null text counts as empty (just the end id); null ids come first; rows with equal id
are ordered by text; an empty table gives a store without shards.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, slices, worker_memo

MAGIC, TAIL = b"KTS1", b"KTSX"
HEAD, ENTRY, FOOT = struct.Struct("<4sB3xQ16s"), np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("tokens", "<u8")]), struct.Struct("<Q4s")
#: Bounds: documents that the dictionary is trained on, leading characters of each used, bytes of the dictionary, bytes of text in a shard.
SAMPLE_DOCS, SAMPLE_BYTES, DICT_BYTES, SHARD_TEXT = 1000, 8192, 64 << 10, 8 << 20


def _byte_classes() -> tuple[bytes, bytes, bytes]:
    """For Latin-1 bytes: lower case, class of each, and for (class before) * 8 + class whether a run starts there.

    Every piece of the tokenizer is a run of letters, one digit, a run of other marks, or an apostrophe with
    letters.  So a run may start after white space, at and after a digit, at a mark after a letter, and at
    a letter after a mark that is no apostrophe.  Control characters and rare white space are left inside runs.
    """
    space, letter, digit, mark, apostrophe, rest = range(6)
    lower, kind = bytearray(range(256)), bytearray([mark] * 256)
    for k in range(256):
        c = chr(k)
        low = c.lower()
        lower[k] = ord(low) if len(low) == 1 and ord(low) < 256 else k
        if c in " \t\n\r":
            kind[k] = space
        elif c.isspace() or k < 32 or 127 <= k < 160 or k == 0xAD:
            kind[k] = rest
        elif c.isalpha():
            kind[k] = letter
        elif c.isnumeric():
            kind[k] = digit
    kind[ord("'")] = apostrophe
    starts = bytearray(256)
    for before in range(5):
        for now in range(1, 5):
            starts[before * 8 + now] = before == space or digit in (before, now) or (before == letter) != (now == letter) and (before, now) != (apostrophe, letter)
    for now in range(1, 6):
        starts[space * 8 + now] = 1
    return bytes(lower), bytes(kind), bytes(starts)


LOWER, KIND, STARTS = _byte_classes()


class WordCoder:
    """Ids by the tokenizers library, asked once per distinct run of text.

    A text's ids are those of its runs one after the other.  Texts of Latin-1 characters are lower-cased, as the
    normalizer would, and cut wherever a piece must end (``_byte_classes``), a whole batch at once; other
    texts, and those that may hold special tokens, are cut at ASCII white space.  Runs of letters are
    asked for many at once: each is one piece, and only a piece's last token has the end mark.
    """

    def __init__(self, path: str, cap: int = 260_000, chars: int = 32 << 20):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.ends = np.zeros(size, bool)
        for token, k in self.library.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith("</w>")
        # Two generations: what the last ``cap`` runs had is still found, so frequent runs stay.
        self.known: dict[str | bytes, bytes] = {"": b""}  # runs of Latin-1 texts are bytes
        self.before: dict[str | bytes, bytes] = {}
        self.cap, self.chars, self.held = cap, chars, 0

    def _singly(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, asked for as one text."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.kind)
        stops = (np.flatnonzero(self.ends[ids]) + 1) * self.width
        if len(stops) != len(words):  # letters to Python that are not to the library
            return self._singly(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]

    def _learn(self, keys: list[str | bytes], runs: list[str]) -> None:
        """Asks for ``runs`` and files them under ``keys``."""
        letters = [r.isalpha() for r in runs]
        plain, names = list(compress(runs, letters)), list(compress(keys, letters))
        for k in range(0, len(plain), 1000):
            self.known.update(zip(names[k : k + 1000], self._together(plain[k : k + 1000]), strict=True))
        mixed = [not x for x in letters]
        self.known.update(zip(compress(keys, mixed), self._singly(list(compress(runs, mixed))), strict=True))

    def _know(self, runs: set[str] | set[bytes]) -> None:
        if len(self.known) > self.cap or self.held > self.chars:
            self.known, self.before, self.held = {"": b""}, self.known if self.held <= 2 * self.chars else {}, 0
        new = runs.difference(self.known)
        self.held += sum(map(len, new))
        old = new.intersection(self.before)
        self.known.update([(w, self.before[w]) for w in old])
        keys = list(new - old)
        if keys:
            self._learn(keys, keys if isinstance(keys[0], str) else b"\n".join(keys).decode("latin-1").split("\n"))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width`` bytes."""
        simple, other = [], []
        for k, text in enumerate(texts):
            try:
                if "<|" not in text:  # special tokens are matched before the normalizer, in lower case only
                    simple.append((k, text.encode("latin-1")))
                    continue
            except UnicodeEncodeError:
                pass
            other.append((k, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
        out = [b""] * len(texts)
        if other:
            self._know(set().union(*(words for _, words in other)))
            for k, words in other:
                out[k] = b"".join(map(self.known.__getitem__, words))
        if simple:
            for (k, _), raw in zip(simple, self._encode_latin([text for _, text in simple]), strict=True):
                out[k] = raw
        return out

    def _encode_latin(self, texts: list[bytes]) -> list[bytes]:
        joined = b" ".join(texts).translate(LOWER)
        kind = np.frombuffer(joined.translate(KIND), np.uint8)
        before = np.zeros_like(kind)
        before[1:] = kind[:-1] << 3
        starts = np.frombuffer((before | kind).tobytes().translate(STARTS), bool)
        kept = kind != 0
        begins = np.append(np.flatnonzero(starts[kept]), np.count_nonzero(kept))
        body = np.frombuffer(joined, np.uint8)[kept]
        runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
        offsets = np.frombuffer(runs.dictionary.buffers()[1], np.int64, len(runs.dictionary) + 1).tolist()
        names = (runs.dictionary.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        distinct = [names[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self._know(set(distinct))
        ids = pa.array([self.known[r] for r in distinct], pa.large_binary()).take(runs.indices)
        stops = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, ids.offset * 8)
        raw = memoryview(ids.buffers()[2] or b"")
        # A text's first run is the number of runs that start before it.
        ahead = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(np.flatnonzero(starts), ahead)
        cuts = stops[first].tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@worker_memo(2)
def word_coder(path: str) -> WordCoder:
    return WordCoder(path)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or b"" if the samples are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@lru_cache(maxsize=4)
def _codec(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
    shared = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=3, dict_data=shared), zstandard.ZstdDecompressor(dict_data=shared)


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def write_shard(ids: list[int | None], arrays: list[bytes], width: int, dictionary: bytes) -> bytes:
    pack = _codec(dictionary)[0].compress
    out, entries = bytearray(HEAD.pack(MAGIC, width, len(ids), dictionary_hash(dictionary))), np.zeros(len(ids), ENTRY)
    for k, (key, raw) in enumerate(zip(ids, arrays, strict=True)):
        entries[k] = (key or 0, key is None, len(out), len(raw) // width)
        out += pack(raw)
    at = len(out)
    return bytes(out + entries.tobytes() + FOOT.pack(at, TAIL))


class Shard:
    """Random access to a shard's documents."""

    def __init__(self, image: bytes, dictionary: bytes):
        magic, self.width, n, named = HEAD.unpack_from(image)
        self.end, tail = FOOT.unpack_from(image, len(image) - FOOT.size)
        if magic != MAGIC or tail != TAIL:
            raise ValueError("not a token shard")
        if named != dictionary_hash(dictionary):
            raise ValueError("the shard was written with another dictionary")
        self.image, self.index = memoryview(image), np.frombuffer(image, ENTRY, n, self.end)
        self.unpack = _codec(dictionary)[1].decompress

    def __len__(self) -> int:
        return len(self.index)

    def read(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        stop = self.index["offset"][k + 1] if k + 1 < len(self) else self.end
        return np.frombuffer(self.unpack(self.image[self.index["offset"][k] : stop]), f"<u{self.width}")

    def find(self, key: int) -> np.ndarray | None:
        """Ids of the first document with this id, by binary search in the index."""
        nulls = int(self.index["null"].sum())
        k = nulls + int(np.searchsorted(self.index["id"][nulls:], key))
        return self.read(k) if k < len(self) and self.index["id"][k] == key else None


def _sample(docs: DataFrame, total: int, path: str, end_id: int) -> list[bytes]:
    """About SAMPLE_DOCS documents (never more than twice that) by a hash of their id and text."""
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", "body"), F.lit(max(1, total // SAMPLE_DOCS))) == 0).limit(2 * SAMPLE_DOCS)
    rows = chosen.select(F.xxhash64("doc_id", "body").alias("h"), F.substring("body", 1, SAMPLE_BYTES).alias("body")).collect()
    coder = word_coder(path)
    end = np.array([end_id], coder.kind).tobytes()
    return [raw + end for raw in coder.encode([r.body for r in sorted(rows)])]


def write_store(docs: DataFrame, path: str, where: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text, appends ``end_id`` and writes a store of ascending ids to ``where``.

    Only the dictionary's training reads a bounded sample; every document is written.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    row = source.agg(F.sum(F.octet_length("body")).alias("size"), F.count("*").alias("n")).first()
    size = row["size"] or 0
    dictionary = train_dictionary(_sample(source, row.n, path, end_id))
    spark.createDataFrame([(dictionary_hash(dictionary), dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{where}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    parts = max(1, -(-size // (2 * SHARD_TEXT)), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def shards(batches):
        coder = word_coder(path)
        end = np.array([end_id], coder.kind).tobytes()
        task, k, ids, arrays, held = None, 0, [], [], 0

        def image():
            first, row = ids[0], write_shard(ids, arrays, coder.width, shared.value)
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([sum(map(len, arrays)) // coder.width], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([row], pa.binary())], ["part", "k", "first_id", "n_tokens", "n_docs", "image"])

        for part in slices(batches, 1, 4 << 20):
            if task is None:
                task = part.column(2)[0].as_py()
            ids += part.column(0).to_pylist()
            arrays += [raw + end for raw in coder.encode(part.column(1).to_pylist())]
            held += part.column(1).nbytes
            if held >= SHARD_TEXT:
                yield image()
                k, ids, arrays, held = k + 1, [], [], 0
        if ids:
            yield image()

    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "body").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(shards, "part int, k int, first_id bigint, n_tokens bigint, n_docs bigint, image binary").write.parquet(f"{where}/shards")
    _write_starts(spark, where)
    return where


def _write_starts(spark: SparkSession, where: str) -> None:
    """Ids before each shard: those of the parts before its part (a row a part, summed up in one task), and of shards before it inside."""
    sizes = spark.read.parquet(f"{where}/shards").select("part", "k", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    within.join(parts, "part").select("part", "k", (F.col("ahead") + F.col("inside")).alias("start")).write.parquet(f"{where}/starts")


STARTS_SCHEMA = "part int, k int, start bigint"
STORE_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_store(spark: SparkSession, where: str) -> DataFrame:
    """Every document of a store: id, number of ids before it, its ids (array<int>)."""
    return _read(spark, where, "doc_id bigint, start bigint, ids array<int>", ["ids"], pa.list_(pa.int32()), lambda ids: ids.astype(np.int32))


def store_digest(spark: SparkSession, where: str) -> DataFrame:
    """Every document of a store: id, start, number of ids, CRC-32 of them as unsigned 32-bit integers."""
    return _read(spark, where, STORE_SCHEMA, ["n_tokens", "ids_crc32"], pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, where: str, schema: str, names: list[str], kind: pa.DataType, value) -> DataFrame:
    # Spark broadcasts the starts if their files are small enough, so images are exchanged in large stores only.
    starts = spark.read.schema(STARTS_SCHEMA).parquet(f"{where}/starts")
    placed = spark.read.parquet(f"{where}/shards").select("part", "k", "image").join(starts, ["part", "k"]).select("start", "image")
    dictionary = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{where}/dictionary").first().dictionary))

    def read(batches):
        for part in slices(batches, 1, 1):
            for start, image in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                shard = Shard(image, dictionary.value)
                n = shard.index["tokens"].astype(np.int64)
                begins = start + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                last = [value(shard.read(k)) for k in range(len(shard))]
                cols = [pa.array(shard.index["id"], mask=shard.index["null"].astype(bool)), pa.array(begins), *([pa.array(n)] if "n_tokens" in names else []), pa.array(last, kind)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", *names])

    return placed.mapInArrow(read, schema)


def store_and_digest(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Writes the texts' ids to a store in the shared folder and digests what is read back from it."""
    spark = docs.sparkSession
    return store_digest(spark, write_store(docs, path, shared_path(spark, "tokens"), end_id))
