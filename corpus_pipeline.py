"""From raw documents to token ids: quality, line dedup, near dedup, mixing, encoding.

Each stage gets what the one before it kept, as a table read from Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from herald.llm import line_dedup, mixing, near_dedup, pieces, quality
from herald.llm._common import read, scratch_dir, temporary, tokenizer_file


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others, repeated rows each; labels of
    null or unknown ids are not learnt from. An empty table stays empty.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites.

    Null texts and rows of a null source stay, repeated rows too; copies keep
    their lines. An empty table stays empty.
    """
    return line_dedup.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of least doc_id.

    Null and empty texts are one group. Rows that repeat doc_id and text count
    once. An empty table stays empty.
    """
    return near_dedup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its budget, repeated where the budget is above the source.

    A null source is a source; empty texts cost nothing and go with those
    beside them; equal rows are planned one by one. An empty table stays empty.
    """
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document of the mix: a row for each row, without ids for a null or empty text."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_boilerplate),
    ("near dedup", without_near_duplicates),
    ("source mix", mixed),
    ("pieces", encoded),
]

#: The classifier, the signatures and the encoding have no SQL; tests compare a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again; columns beyond those a stage names pass through."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{scratch_dir(spark)}/herald-{spark.sparkContext.applicationId}-stage{i}-{uuid.uuid4().hex}"
        with temporary(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
