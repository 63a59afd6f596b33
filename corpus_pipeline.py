"""A training corpus from ``documents``: rejects, near copies, repeats and benchmark leaks go, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes as Parquet and reads
again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keystrata.llm import bpe, decontaminate, quality, simhash, suffix_dedup
from keystrata.llm.common import shared_path, table


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier takes for good."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate component."""
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without strings of 100 bytes that start earlier."""
    return suffix_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item: from one on a document is affected."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded bytes."""
    return bpe.token_digest(docs, *bpe.default_vocabulary())


STAGES = [
    ("quality classifier", drop_rejected),
    ("SimHash near-dedup", keep_one_of_each),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The classifier, fingerprints, suffix arrays and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on its predecessor's Parquet files in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_path(spark, f"stage{k}")
            made.write.parquet(path)
            made = spark.read.parquet(path)
        docs = made
    return docs
