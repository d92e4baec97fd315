"""Queries of this subpackage over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import binary, extraction, langid, media, mixing, negatives, neighbours, packing, scoring, secrets, simhash, spelling, suffixes
from evidentia.llm.oracle import ORACLE_SQL  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.score(documents(spark, sf_dir))
    return d.withColumns({c: F.round(c, 4) for c in ("logprob", "mean_logprob")})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.token_table(documents(spark, sf_dir))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(e.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_lm_score, op4_suffix_dedup, op5_neighbours, op6_secrets, op7_packing, op8_media, op9_language, op10_token_ids, op11_html_text, op12_hard_negatives, op13_spelling)}
