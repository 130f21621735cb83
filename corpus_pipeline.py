"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Each stage keeps the columns of `documents`; the last one returns a row for each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagsmith.llm import bpe, decontamination, ngram_join, pii, quality
from tagsmith.llm.common import stored
from tagsmith.llm.queries import PII_KEY, read, vocabulary


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the co-trained classifier rejects."""
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8 or more."""
    return ngram_join.without_copies(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With surrogates for personal data."""
    return pii.pseudonymised(docs, PII_KEY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the decoded text, as digests."""
    return bpe.round_trip(docs, vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("PII", pseudonymised),
    ("BPE encoding and decoding", encoded),
]
#: SQL can't express the classifier, the surrogates or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs


def oracles() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
