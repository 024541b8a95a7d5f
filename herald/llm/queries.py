"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herald.llm import (
    chat, fingerprint, lexical, license_scan, line_dedup, line_quality, mixing, near_dedup, pieces, quality, resample, token_store, url_filter,
)
from herald.llm._common import read, scratch_dir, tokenizer_file


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and class_id: the least doc_id among its near duplicates."""
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the token store in the shared folder, reads it back, and digests each document's ids."""
    path = f"{scratch_dir(spark)}/herald-{spark.sparkContext.applicationId}-tokens-{uuid.uuid4().hex}"
    token_store.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return token_store.read_digests(spark, path)


def op3_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered turns of conversations that no longer snapshot contains."""
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain counts, base rule and verdict of each document."""
    return line_quality.verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("boilerplate")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, the likenesses, and how many fingerprints lie within three bits."""
    return fingerprint.with_neighbours(fingerprint.neighbour_likeness(read(spark, sf_dir, "documents")))


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    return quality.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, those dropped as boilerplate, and the digest of what is left."""
    return line_dedup.report(read(spark, sf_dir, "documents"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pieces: counts, digest of the ids, and whether decoding gives the text back."""
    return pieces.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and inherited licences of each document."""
    files = license_scan.documents_as_files(read(spark, sf_dir, "documents"))
    return license_scan.scan(files, licence_file=license_scan.opens_with_licence()).withColumnRenamed("file_id", "doc_id")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of each page, by rules or by the reputation of its host."""
    return url_filter.judge(read(spark, sf_dir, "pages"), url_filter.outcomes_of_labels(read(spark, sf_dir, "labels")))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document, with the benchmark's texts as the target."""
    found = resample.importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("n_words")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_token_store, op3_chat_turns, op4_line_quality, op5_source_mix, op6_fingerprints, op7_quality_scores,
        op8_line_dedup, op9_pieces, op10_license_scan, op11_url_filter, op12_importance_resample, op13_ranked_search,
    )
}

SQL: dict[str, str] = {
    "op3_chat_turns": chat.SQL,
    "op5_source_mix": mixing.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op10_license_scan": license_scan.sql(),
    "op11_url_filter": url_filter.sql(),
    "op12_importance_resample": resample.SQL,
    "op13_ranked_search": lexical.SQL,
}
