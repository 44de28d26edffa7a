"""Hash folds of documents, and labelled training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, apart: tuple[int, int], limit: int, text: str = "text", seed: str = "fit-1") -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` documents with a label of 0 or 1, of the folds (n, k) but fold k.

    The ids with the smallest seeded hashes are drawn from the labels alone, alike in
    any run; they are few by the limit, so they are broadcast and no other text shuffles.  An id that
    repeats gives one row, with its smallest text, and the smaller of different labels.
    """
    n, k = apart
    marks = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), n) != k)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    drawn = marks.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
