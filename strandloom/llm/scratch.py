"""Intermediate tables in the cluster's shared folder.

``staged`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and
reads it back, which cuts lineage and survives the loss of executors.  Where the
setting is absent and the session runs on one machine (tests, notebooks) a folder of that machine is used, one for
the application; on a cluster it must be set.
Tables stay as long as results may be read from them; ``clear`` deletes those of the application.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    found = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        name = spark.sparkContext.applicationId
        found = _own[name] if name in _own else _own.setdefault(name, f"file://{tempfile.mkdtemp(prefix='strandloom-')}")
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; what reads from them can't be read any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
