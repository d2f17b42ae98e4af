"""The queries of this subpackage, by name, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import archive, decontaminate, embedding_dedup, kneser_ney, mixing, quality, sharding, token_counts, url_filter
from keyloom.llm._shared import cut
from keyloom.llm.simhash_dedup import simhash_groups


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.coalesce(_remainder(7), F.lit(0)) == 2).alias("held_out"))
    model = kneser_ney.train(docs.where("not held_out").select("text"))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ready = cut(quality.with_features(docs).drop("text"), "features")
    learning = F.coalesce(_remainder(5), F.lit(1)) != 0
    model = quality.learn(ready, table(spark, sf_dir, "labels"), learning)
    scored = quality.with_scores_of(ready, model)
    return scored.select("doc_id", (~learning).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, 16).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.round("_probability", 9).alias("probability"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(table(spark, sf_dir, "pages")).drop("url", "payload")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


RULES = [
    url_filter.Rule("block", "com", "/en/"),
    url_filter.Rule("allow", "example.com", "/en/7"),
    url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"),
    url_filter.Rule("block", "org", "/es/"),
]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, RULES).drop("url")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney": op1_kneser_ney,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_quality": op4_quality,
    "op5_jump_sharding": op5_jump_sharding,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
}
