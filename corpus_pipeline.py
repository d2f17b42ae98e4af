"""The corpus pipeline: stages that each write their rows for the next one to read.

Quality classifier, near-duplicates, benchmark decontamination, mixing to target weights, sharding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontaminate, mixing, quality, sharding, simhash_dedup
from keyloom.llm._shared import carried, cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled ones, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn_from_texts(docs, labels, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(1)) != 0)
    text = f"c{docs.columns.index('text')}"
    scored = quality.with_scores(carried(docs), model, text, "score").where(F.col("score") >= quality.THRESHOLD)
    return scored.drop("score").toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    return simhash_dedup.keep_representatives(docs, similar=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of tokens."""
    return mixing.mix(docs, marks=False)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place."""
    return sharding.assign(docs, 16)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Fingerprints and the classifier's arithmetic are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
