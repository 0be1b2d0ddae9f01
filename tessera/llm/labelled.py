"""The bounded sample of labelled texts that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Most labelled rows that a model is fitted on; the fit runs on the driver.
SAMPLE_ROWS = 6000


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = SAMPLE_ROWS) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `most` rows with a label of 0 or 1 whose crc32(doc_id) mod 5 is not 0, chosen by a hash of doc_id.

    Rows without a label are left out. A repeated doc_id counts once, with its greatest label and its greatest text.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    marked = marked.filter(crc_fold(F.col("doc_id")) != 0)
    order = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = marked.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(order, "doc_id").limit(most)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # One row a doc_id before anything comes to the driver.
    once = src.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    rows = sorted(once.collect(), key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["label"] for r in rows]
