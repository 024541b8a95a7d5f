"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session of local threads without it, as in tests, gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    shared_folder.own = getattr(shared_folder, "own", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{shared_folder.own}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_folder(spark)}/herald-{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a table in the shared folder, read back: lineage is cut, and lost executors cost a task."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
