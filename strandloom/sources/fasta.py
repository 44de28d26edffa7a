"""FASTA in and out, as DataFrames of (seq_id, name, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; files are split between records, so a large file is read by many tasks.

    ``name`` is the first word of the header line, ``seq`` all other lines joined.  ids differ, and are not
    consecutive.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace(F.col("value"), "^>", "")
    lines = F.split(body, "\r?\n", 2)
    seq = F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"\s", "")
    header = F.get(lines, F.lit(0))
    return raw.where(F.length(F.trim("value")) > 0).select(F.monotonically_increasing_id().alias("seq_id"), F.regexp_extract(header, r"^(\S*)", 1).alias("name"), seq.alias("seq"))


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")).write.text(path)
