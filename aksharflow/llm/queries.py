"""Queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding, exact_dedup, langid, lm, mixing, packing, quality, simhash, toxicity
from .common import read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read(spark, sf_dir, "documents"))


def op3_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.prefix_trees(read(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexity(read(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_chat_trees, op4_quality, op5_lm_scoring, op6_language_id, op7_embedding_dedup, op8_packing, op9_exact_dedup, op10_toxicity)}
ORACLE_SQL = {"op2_mixing": mixing.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL}
