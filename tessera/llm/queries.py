"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The stages' queries are in corpus_pipeline.py, which adds its own.
from . import bpe_prefix, exact_fingerprint, gif_media, packing, quality_crf, simhash_balls, suffix_dedup, token_counts, token_store, toxic_mil
from .common import Scratch, table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score(docs, quality_crf.learn(docs, table(spark, sf_dir, "labels")))


def op2_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode_digests(table(spark, sf_dir, "documents"))


def op3_exact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_fingerprint.edited_neighbours(table(spark, sf_dir, "documents"))


def op4_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.store_texts(table(spark, sf_dir, "documents"), with_media=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_balls.classes(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    token_store.write_store(spark, table(spark, sf_dir, "documents"), scratch)
    return token_store.read_store(spark, scratch, with_ids=False)


def op8_toxic_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_mil.score(docs, toxic_mil.learn(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_bpe_prefix, op3_exact_fingerprint, op4_gif_media, op5_token_counts, op6_simhash_balls, op7_token_store, op8_toxic_mil, op9_packing, op10_suffix_dedup)}

#: No operator's rows can be had from SQL: models, tokenizers, xxhash64, LZW, packing. Brute-force tests stand in their place.
ORACLE_SQL: dict[str, str] = {}

__all__ = ["ORACLE_SQL", "QUERIES"]
