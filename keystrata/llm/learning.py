"""What the trained operators share: the bounded sample of labelled texts and the numbering of tokens."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Codes(dict):
    def __init__(self):
        super().__init__()
        self.tokens: list[str] = []
        self.chars = 0

    def __missing__(self, token: str) -> int:
        code = self[token] = len(self.tokens)
        self.chars += len(token)
        self.tokens.append(token)
        return code


class Reader:
    """Cuts texts into tokens and numbers the distinct ones; forgets them all when there are too many.

    ``cleared`` counts how often; codes of one count stay what they are.
    """

    def __init__(self, cap: int = 300_000, chars: int = 32 << 20):
        self.cap, self.chars, self.cleared = cap, chars, 0
        self.clear()

    def clear(self) -> None:
        self.cleared += 1
        self.codes = _Codes()
        self.tokens = self.codes.tokens

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the text's tokens; positions after which a line ends."""
        if len(self.tokens) > self.cap or self.codes.chars > self.chars:
            self.clear()
        code, out, lines = self.codes.__getitem__, [], []
        for line in text.split("\n"):
            out += map(code, line.split())
            lines.append(len(out))
        return np.array(out, np.int64), np.array(lines, np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out, rows: int, chars: int) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled whole texts outside the held-out fold, in the order of a hash of the id.

    About ``rows`` labels (twice that at most) and ``chars`` characters; texts over a sixteenth of ``chars`` are left out.
    Rows without id or label are not learnt from; several labels of an id count as their largest.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    open_ = marked.where(~held_out)
    # The ids whose hash is a multiple are about `rows` of them; the limit only bounds the chance excess.
    every = max(1, round(open_.count() / rows))
    chosen = open_.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body")).where(F.length("body") <= chars // 16).join(F.broadcast(chosen), "doc_id")
    # Ids and lengths first: of the texts, only those that fit in `chars` are sent.
    sized, fit, held = texts.groupBy("doc_id").agg(F.sum(F.length("body")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id"), [], 0
    for r in sized.collect():
        held += r.n
        if held > chars:
            break
        fit.append((r.doc_id,))
    if not fit:
        return [], np.zeros(0)
    wanted = docs.sparkSession.createDataFrame(fit, texts.select("doc_id").schema)
    rows = texts.join(F.broadcast(wanted), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "body").select("body", "y").collect()
    return [r.body for r in rows], np.array([r.y for r in rows], float)
