"""Shared pieces of the training-data operators: scratch tables, text keys, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: The same class as a Python pattern of whole words.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, by any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    A session of local threads, as in tests, gets a folder of its own if that
    is unset; on a cluster executors would write to disks of their own, so
    there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    scratch_dir.own = getattr(scratch_dir, "own", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"file://{scratch_dir.own}"


_open: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, fixes anything that depends on how rows were dealt
    to partitions, and survives the loss of executors. Within
    :func:`temporary` the table goes when the block ends; else it stays until
    :func:`drop_scratch`, as what is returned may still read it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/herald-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are materialized inside; for work whose result is written inside."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, pattern: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(path) or []:
        fs.delete(status.getPath(), True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables from the shared folder."""
    _delete(spark, f"{scratch_dir(spark)}/herald-{spark.sparkContext.applicationId}-*")


def text_of(col: str | Column) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def text_key(col: Column) -> list[Column]:
    """Two independent 64-bit hashes: together a key for equal texts."""
    return [F.xxhash64(col).alias("k1"), F.xxhash64(F.lit("herald"), F.reverse(col), F.length(col)).alias("k2")]


def words(col: Column) -> Column:
    """Array of the words of a text."""
    return F.filter(F.split(col, SPACE), lambda w: w != F.lit(""))


def n_words(col: Column) -> Column:
    """Number of words; 0 for a null or blank text."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, as the package of these files gives it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
