"""The corpus pipeline: documents in, a cleaned and mixed training corpus out.

Each stage works on all that its predecessor kept; its result is written as Parquet in the
shared folder and read again as the next one's documents, so that a lost executor
costs a stage at most.  All stages but the last return the columns of documents, and
so does the last, with rows as often as the mix takes them.

Odd rows, stage by stage: texts without words (null, empty, blank) break the base rule of the first stage and go there; given to a
later stage by themselves, they stay, each a class of its own, clean, unchanged, and are taken 0 words or as often as their
source.  Rows that repeat are one in near_dedup and alike in all others; different texts under one id are documents of their own.
Null ids stay.  Very long texts are read whole.  An empty table gives an empty one with the same columns, and
further columns travel along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontam, minhash, mixing, pii, rules
from strandloom.llm.scratch import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced, and checked for collisions; ``n_chars`` follows the new text."""
    out = pii.checked(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("source_mixing", source_mixing),
]

#: SQL can't express the signatures of near_dedup nor the surrogates; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
