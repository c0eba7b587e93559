"""A pipeline over documents: each stage works on what the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.functions.bounded import work_path
from flowsieve.llm import bpe, decontaminate, quality, simhash, toxicity
from flowsieve.llm.shared import table

# Words a coder remembers; other stages' workers are still there when coders start.
CODER_WORDS = 60_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier and their site speak for; an empty table stays empty."""
    return quality.good_rows(docs, table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; null texts stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(docs["text"], model, spark) < 0.5)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of fingerprints linked at the operator's own distance.

    Shingles of three words, at most 3 of 64 bits apart; null and empty texts are one group.
    """
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; null, empty and very long texts are searched whole."""
    return docs.where(~decontaminate.contaminated(docs["text"], table(spark, sf_dir, "benchmark")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text decoded from them; a null text counts as empty."""
    return bpe.round_trip(docs, memory=CODER_WORDS)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", drop_leaks),
    ("byte_level_bpe", tokenize),
]

# Models, near duplicates and merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
