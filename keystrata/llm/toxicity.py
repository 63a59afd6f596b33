"""Toxicity by multiple-instance learning (operator 1).

A text is a bag of sentences.  A sentence's logit is the sum of the weights of its hashed features (each
word and its leading 4 to 7 letters) plus a bias; the text's raw probability is the noisy-or of its
sentences, 1 - prod(1 - p).  Only texts are labelled: the gradient of the text's log loss flows through
the noisy-or to the sentences, which is what lets ``offending_sentences`` point at them.  A final
monotone logistic curve on the log of the expected number of toxic sentences, -log prod(1 - p), maps the
noisy-or to a calibrated score.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS``, chosen by a hash of the id, whole
texts of at most ``TRAIN_CHARS`` characters in all); scoring covers every whole text of any length.

Defined results: null and empty texts score like a text without sentences (the curve's value for none);
null or missing labels are not learnt from; without labels of both kinds every score is the share of
toxic labels (0 without labels); repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, fold, forgets, map_slices
from .learning import Reader, labelled

BUCKETS = 1 << 19
PREFIXES = (4, 5, 6, 7)
#: Bounds of the training sample, on the driver.
TRAIN_ROWS, TRAIN_CHARS = 6000, 16_000_000
ROUNDS, RATE, RIDGE = 40, 0.5, 1e-4
#: Features kept: in so many texts at least, toxic ones above their share by so many standard errors.
RARE, TELLING = 4, 3.0
CURVE_SHARE = 4
THRESHOLD = 0.3


def features(token: str) -> list[int]:
    """Buckets of a token's letters, lower-cased, and of their leading parts."""
    word = token.lower() if token.isalpha() else "".join(filter(str.isalpha, token.lower()))
    if not word:
        return []
    return [zlib.crc32(f"={word}".encode()) % BUCKETS, *(zlib.crc32(word[:n].encode()) % BUCKETS for n in PREFIXES if len(word) >= n)]


def ends_sentence(token: str) -> bool:
    return token.rstrip("\"')]}»”*#$%&")[-1:] in ".!?。！？" and bool(token)


class Model(NamedTuple):
    weights: np.ndarray  #: float32, of BUCKETS
    bias: float  #: of a sentence
    slope: float  #: of the curve
    offset: float
    constant: float | None = None  #: the score of everything, if nothing could be learnt

    def curve(self, expected: np.ndarray) -> np.ndarray:
        """Scores of texts by their expected number of toxic sentences, -log prod(1 - p)."""
        if self.constant is not None:
            return np.full(len(expected), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(expected + 1e-6) + self.offset, -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def sentence_ids(ends: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The number of each token's sentence, from the flags of its last tokens and the ends of lines."""
    n = len(ends)
    breaks = np.zeros(n + 1, bool)
    breaks[1:] = ends
    breaks[lines] = True
    return np.cumsum(breaks[:n]) - (1 if n and breaks[0] else 0)


def train(texts: list[str], labels: np.ndarray) -> Model:
    if len(texts) == 0 or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0, float(labels.mean()) if len(texts) else 0.0)
    known, ids, sentence, doc = Cache(features), [], [], []
    total, y = 0, labels.astype(float)
    # One text in CURVE_SHARE is kept from the weights, for the curve; features must tell the kinds apart in the rest.
    aside = np.arange(len(texts)) % CURVE_SHARE == 0
    if y[aside].min() == y[aside].max() or y[~aside].min() == y[~aside].max():
        aside[:] = False
    fitted = ~aside
    there, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for d, text in enumerate(texts):
        reader = Reader()
        codes, lines = reader.read(text)
        place = sentence_ids(np.array([ends_sentence(t) for t in reader.tokens], bool)[codes] if len(codes) else np.zeros(0, bool), lines)
        found = [known[t] for t in reader.tokens]
        width = np.array([len(f) for f in found], np.int64)
        flat, start = np.array([x for f in found for x in f], np.int32), np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
        if len(codes):
            each = width[codes]
            at = np.repeat(start[codes] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            ids.append(flat[at])
            if fitted[d]:
                once = np.unique(flat)
                there[once] += 1
                toxic[once] += y[d]
            sentence.append((np.repeat(place, each) + total).astype(np.int32))
            n = int(place[-1]) + 1
            doc.append(np.full(n, d, np.int32))
            total += n
    ids, sentence, doc = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (ids, sentence, doc))
    share = y[fitted].mean()
    telling = (there >= RARE) & (toxic - share * there >= TELLING * np.sqrt(there * share * (1 - share)))
    keep = telling[ids]
    ids, sentence = ids[keep], sentence[keep]
    prior = np.clip(y.mean(), 0.01, 0.99)
    bias, weights, seen = float(np.log(prior / max(1.0, total / len(texts))) - 1), np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    bias_seen = 1e-8
    for _ in range(ROUNDS):
        z = np.clip(np.bincount(sentence, weights[ids], minlength=total) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        expected = np.bincount(doc, _softplus(z), minlength=len(texts))
        clean = np.exp(-expected)
        factor = np.where(y == 1, -clean / np.maximum(1 - clean, 1e-4), 1.0) * fitted
        slope = factor[doc] * p
        g = np.bincount(ids, slope[sentence], minlength=BUCKETS) + RIDGE * len(texts) * weights
        seen += g * g
        weights -= RATE * g / np.sqrt(seen)
        g = slope.sum()
        bias_seen += g * g
        bias -= 0.1 * g / np.sqrt(bias_seen)
    z = np.clip(np.bincount(sentence, weights[ids], minlength=total) + bias, -30, 30)
    x = np.log(np.bincount(doc, _softplus(z), minlength=len(texts)) + 1e-6)
    if aside.any():
        x, y = x[aside], y[aside]
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps of a two-parameter logistic regression
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [((q - y) * x).sum() + 1e-3 * a, (q - y).sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return Model(weights.astype(np.float32), bias, max(float(a), 1e-3), float(b))


class Scorer:
    """Scores texts with a model; a worker keeps one."""

    def __init__(self, model: Model):
        self.model, self.reader = model, Reader()
        self.weight = np.zeros(1 << 10, np.float32)
        self.ends = np.zeros(1 << 10, bool)
        self.filled = 0

    def _fill(self) -> None:
        tokens = self.reader.tokens
        if len(tokens) > len(self.weight):
            self.weight, self.ends = (np.resize(x, 2 * len(tokens)) for x in (self.weight, self.ends))
        w = self.model.weights
        for k in range(self.filled, len(tokens)):
            t = tokens[k]
            self.weight[k] = sum([w[i] for i in features(t)])
            self.ends[k] = ends_sentence(t)
        self.filled = len(tokens)

    def sentences(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each sentence; the number of each token's sentence."""
        before = self.reader.cleared
        codes, lines = self.reader.read(text)
        if self.reader.cleared != before:
            self.filled = 0
        self._fill()
        if not len(codes):
            return np.zeros(0), np.zeros(0, np.int64)
        place = sentence_ids(self.ends[codes], lines)
        return np.bincount(place, self.weight[codes]) + self.model.bias, place

    def expected(self, text: str) -> float:
        return float(_softplus(np.clip(self.sentences(text)[0], -30, 30)).sum())


_scorers: dict[int, Scorer] = {}
forgets(__name__, _scorers.clear)


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of this model: what it knows of tokens outlives a task."""
    key = zlib.crc32(model.weights.tobytes(), zlib.crc32(repr(model[1:]).encode()))
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_sentences bigint, worst_sentence bigint"


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Learns from rows whose crc32(doc_id as text) mod 4 is not 2."""
    return train(*labelled(docs, labels, label, fold(2, 4), TRAIN_ROWS, TRAIN_CHARS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores every text; ``worst_sentence`` is the 0-based number of its likeliest toxic sentence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fold(2, 4).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scorer = scorer_of(shared.value)
        expected, counts, worst = [], [], []
        for text in part.column(2).to_pylist():
            z, _ = scorer.sentences(text)
            expected.append(_softplus(np.clip(z, -30, 30)).sum())
            counts.append(len(z))
            worst.append(int(z.argmax()) if len(z) else None)
        scores = shared.value.curve(np.array(expected))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(counts, pa.int64()), pa.array(worst, pa.int64())], [f.split()[0] for f in SCHEMA.split(", ")])

    return map_slices(source, "body", SCHEMA, run)


def offending_sentences(docs: DataFrame, model: Model, above: float = 0.5) -> DataFrame:
    """(doc_id, sentence, p, text) of every sentence whose own probability exceeds ``above``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"))
    limit = float(np.log(above / (1 - above)))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scorer, rows = scorer_of(shared.value), []
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            z, place = scorer.sentences(text)
            tokens = np.array(text.split(), object)
            rows += [(doc_id, int(k), float(1 / (1 + np.exp(-z[k]))), " ".join(tokens[place == k])) for k in np.flatnonzero(z > limit)]
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True)], ["doc_id", "sentence", "p", "text"])

    return map_slices(source, "body", "doc_id bigint, sentence bigint, p double, text string", run)
