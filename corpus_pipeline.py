"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, and whatever other columns docs has, under any names.

* Null text: an empty one to every stage. Quality judges it like any other, and what stays is packed as an end id alone.
* Null doc_id: a document like any other. It comes last in its class, so that near copies with a doc_id stay instead.
* Repeated rows: of one class, so that one stays, even where doc_id, text and all else are equal. Rows with one doc_id
  and different texts are different documents.
* Ties: equal scores are judged alike; which of two equal documents stays is said in simhash_balls.
* Empty table: every stage returns no rows.
* Very long texts: scored, fingerprinted and cut whole; packing cuts them into full windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality_crf, simhash_balls, suffix_dedup, toxic_mil
from tessera.llm.common import Scratch, hand_back, table

#: Five-word shingles, as for all near duplicates without a contract of their own.
SHINGLE_WORDS = 5


def beginning(spark: SparkSession) -> None:
    """Executors give back what the stage before has left in them, so that no stage runs in another's heap."""
    hand_back(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores under its threshold go."""
    beginning(spark)
    field = quality_crf.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_crf.keep(docs, field)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model scores at its threshold or over go."""
    beginning(spark)
    model = toxic_mil.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxic_mil.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the smallest doc_id's; fingerprints within 4 bits link, and so do sets of shingles of similarity 0.8 or more."""
    beginning(spark)
    return simhash_balls.keep_first(docs, words=SHINGLE_WORDS, similar_sets=True)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings are cut out of the texts; n_chars follows."""
    beginning(spark)
    cut = suffix_dedup.cut_texts(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("bigint")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids."""
    beginning(spark)
    return packing.pack_documents(docs)


#: Name and function of each stage, in order.
STAGES = [("quality", quality), ("toxicity", toxicity), ("near_dedup", near_dedup), ("repeated_text", repeated_text), ("packing", pack)]

#: Trained models and tokenizers are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)


QUERIES = {"pipeline": pipeline}
