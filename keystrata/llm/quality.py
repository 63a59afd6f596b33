"""Quality classifier: a factorisation machine (operator 5).

A text's features are its hashed words and word shapes (counts, scaled to unit length) and standardised
statistics of its structure and size.  The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

whose last term holds all pairwise interactions <v_i, v_j> x_i x_j in time linear in the features.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS`` by a hash of the id, ``TRAIN_CHARS`` in
all); scoring covers every whole text.  Labels, lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts are texts without words, scored by their statistics; null or
missing labels are not learnt from; without labels of both kinds every score is the share of label 1
(0 without labels); repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_slices, worker_memo
from .learning import Reader, labelled

BUCKETS, FACTORS = 1 << 18, 8
#: Bounds of the training sample, on the driver.
TRAIN_ROWS, TRAIN_CHARS = 6000, 16_000_000
ROUNDS, RATE, RIDGE, RIDGE_V = 60, 0.1, 2e-3, 2e-3
#: Hashed features kept: in so many texts at least, off the labels' share by so many standard errors.
RARE, TELLING = 5, 3.0
THRESHOLD = 0.3
STATS = ("chars", "tokens", "lines", "word length", "letters", "upper", "digits", "symbols", "bare symbols", "distinct tokens", "commonest token", "distinct pairs", "distinct lines", "commonest line", "tokens a line")


def shape(token: str) -> str:
    """Letters as a or A, digits as 0, runs collapsed."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in token)
    return "".join(k for k, _ in groupby(kinds))


def buckets(token: str) -> tuple[int, int]:
    return zlib.crc32(token.lower().encode()) % BUCKETS, zlib.crc32(b"\0" + shape(token).encode()) % BUCKETS


def measures(token: str) -> tuple[int, int, int, int, int]:
    """Letters, upper-case letters, digits, other characters, whether there are only others."""
    if token.isalpha():
        upper = sum(map(str.isupper, token)) if not token.islower() else 0
        return len(token), upper, 0, 0, 0
    letters, digits = sum(map(str.isalpha, token)), sum(map(str.isdigit, token))
    return letters, sum(map(str.isupper, token)), digits, len(token) - letters - digits, int(not letters and not digits)


class Featurizer:
    """Turns texts into (buckets, values) and statistics; remembers tokens."""

    def __init__(self):
        self.reader = Reader(200_000)
        self.clear()

    def clear(self) -> None:
        self.filled, self.hashed, self.counts = 0, np.zeros((1 << 10, 2), np.int64), np.zeros((1 << 10, 5))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        before = self.reader.cleared
        codes, lines = self.reader.read(text)
        tokens = self.reader.tokens
        if self.reader.cleared != before:
            self.clear()
        if len(tokens) > len(self.hashed):
            self.hashed, self.counts = (np.concatenate([x, np.zeros((2 * len(tokens) - len(x), x.shape[1]), x.dtype)]) for x in (self.hashed, self.counts))
        for k in range(self.filled, len(tokens)):
            self.hashed[k] = buckets(tokens[k])
            self.counts[k] = measures(tokens[k])
        self.filled = len(tokens)
        n = len(codes)
        if n:
            kinds, times = np.unique(codes, return_counts=True)
            sums = times @ self.counts[kinds]
            pairs = len(np.unique(codes[1:] << 32 | codes[:-1])) / max(1, n - 1)
            marks, which = np.unique(self.hashed[kinds].ravel(), return_inverse=True)
            values = np.bincount(which, np.repeat(times, 2))
            values = np.sqrt(values)
            values /= np.sqrt((values**2).sum())
        else:
            kinds, times, sums, pairs = np.zeros(0, np.int64), np.zeros(1), np.zeros(5), 1.0
            marks, values = np.zeros(0, np.int64), np.zeros(0)
        full = [x for x in text.split("\n") if x]
        commonest = max(map(full.count, set(full))) if 0 < len(full) <= 64 else (1 if not full else _top(full))
        chars, size = max(1.0, sums[0] + sums[2] + sums[3]), max(1, n)
        stats = np.array([np.log1p(len(text)), np.log1p(n), np.log1p(len(full)), chars / size, sums[0] / chars, sums[1] / max(1, sums[0]), sums[2] / chars, sums[3] / chars, sums[4] / size, len(kinds) / size, times.max() / size, pairs, len(set(full)) / max(1, len(full)), commonest / max(1, len(full)), np.log1p(n / max(1, len(full)))])
        return marks, values, stats


@worker_memo(1)
def featurizer() -> Featurizer:
    """The worker's featurizer: what it knows of tokens outlives a task."""
    return Featurizer()


def _top(items: list[str]) -> int:
    from collections import Counter

    return Counter(items).most_common(1)[0][1]


class Model(NamedTuple):
    w0: float
    w: np.ndarray  #: of BUCKETS + len(STATS)
    v: np.ndarray  #: the same by FACTORS
    mean: np.ndarray  #: of the statistics
    scale: np.ndarray
    constant: float | None = None

    def logit(self, marks: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        at = np.concatenate([marks, np.arange(BUCKETS, BUCKETS + len(STATS))])
        x = np.concatenate([values, np.clip((stats - self.mean) / self.scale, -4, 4)])
        vx = self.v[at] * x[:, None]
        return self.w0 + self.w[at] @ x + 0.5 * float((vx.sum(0) ** 2 - (vx**2).sum(0)).sum())

    def score(self, marks: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.logit(marks, values, stats), -30, 30))))


def train(texts: list[str], labels: np.ndarray) -> Model:
    size = BUCKETS + len(STATS)
    if len(texts) == 0 or labels.min() == labels.max():
        return Model(0.0, np.zeros(0), np.zeros((0, FACTORS)), np.zeros(len(STATS)), np.ones(len(STATS)), float(labels.mean()) if len(texts) else 0.0)
    made = Featurizer()
    rows = [made(t) for t in texts]
    y, n = labels.astype(float), len(texts)
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    doc = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    at, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    share = y.mean()
    there, ones = np.bincount(at, minlength=BUCKETS), np.bincount(at, y[doc], minlength=BUCKETS)
    telling = (there >= RARE) & (np.abs(ones - share * there) >= TELLING * np.sqrt(there * share * (1 - share)))
    keep = telling[at]
    doc, at, x = doc[keep], at[keep], x[keep]
    doc = np.concatenate([doc, np.repeat(np.arange(n), len(STATS))])
    at = np.concatenate([at, np.tile(np.arange(BUCKETS, size), n)])
    x = np.concatenate([x, np.clip((stats - mean) / scale, -4, 4).ravel()])
    used, at = np.unique(at, return_inverse=True)
    m = len(used)
    rng = np.random.default_rng(7)
    w0, w, v = float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.05, (m, FACTORS))
    seen0, seen_w, seen_v = 1e-8, np.full(m, 1e-8), np.full((m, FACTORS), 1e-8)
    for _ in range(ROUNDS):
        vx = v[at] * x[:, None]
        total = np.stack([np.bincount(doc, vx[:, f], minlength=n) for f in range(FACTORS)], 1)
        z = w0 + np.bincount(doc, w[at] * x, minlength=n) + 0.5 * ((total**2).sum(1) - np.bincount(doc, (vx**2).sum(1), minlength=n))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gx = g[doc] * x
        grad_w = np.bincount(at, gx, minlength=m) + RIDGE * w / 10
        pull = gx[:, None] * (total[doc] - vx)
        grad_v = np.stack([np.bincount(at, pull[:, f], minlength=m) for f in range(FACTORS)], 1) + RIDGE_V * v / 10
        seen0, seen_w, seen_v = seen0 + g.sum() ** 2, seen_w + grad_w**2, seen_v + grad_v**2
        w0 -= RATE * g.sum() / np.sqrt(seen0)
        w -= RATE * grad_w / np.sqrt(seen_w)
        v -= RATE * grad_v / np.sqrt(seen_v)
    full_w, full_v = np.zeros(size, np.float32), np.zeros((size, FACTORS), np.float32)
    full_w[used], full_v[used] = w, v
    return Model(w0, full_w, full_v, mean, scale)


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 0."""
    return train(*labelled(docs, labels, label, fold(0, 5), TRAIN_ROWS, TRAIN_CHARS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every text; predicted is 1 from THRESHOLD on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fold(0, 5).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        made, model = featurizer(), shared.value
        scores = np.array([model.score(*made(t)) for t in part.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], [f.split()[0] for f in SCHEMA.split(", ")])

    return map_slices(source, "body", SCHEMA, run)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text is predicted to be good, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        made, model = featurizer(), shared.value
        return part.filter(pa.array([model.score(*made(t or "")) >= THRESHOLD for t in part.column(at).to_pylist()], pa.bool_()))

    return map_slices(docs, "text", docs.schema, run)
