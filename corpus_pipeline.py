"""From documents to token ids: quality, rules, near duplicates, benchmark passages, byte-level BPE.

Every stage reads what its predecessor kept, from Parquet, and its decisions take effect. All but the last return the
columns of `documents`; the last returns doc_id, n_tokens and ids. Null and empty texts fall to the quality rules, extra
columns pass through, and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from placewise.llm import byte_bpe, decontamination, near_duplicates, quality_crf, quality_rules, vocabularies
from placewise.llm.storage import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on labelled documents outside the held-out quarter, scores as good."""
    return quality_crf.keep_good(docs, quality_crf.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def passes_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left."""
    encoded = byte_bpe.encode(docs, vocabularies.default_path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", passes_rules),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]

#: SQL can express neither the classifier nor the merges; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
