"""Verification of messages by evidence that a search of current notice versions finds, for tables and for batches of a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from herald.operators import claims as C
from herald.operators import fusion, impact_index, metric_index
from herald.operators import verify as V
from herald.sources.scratch import written


@dataclass
class Evidence:
    """What messages are held against: both indexes of the chunks, the chunks (chunk_id, notice_id, version_id, is_latest),
    reviewed obligations of versions and the versions' validity."""

    words: impact_index.Index
    vectors: metric_index.Index
    chunks: DataFrame
    obligations: DataFrame
    validity: DataFrame


def index_chunks(chunks: DataFrame, obligations: DataFrame, validity: DataFrame) -> Evidence:
    """Index chunks (chunk_id, notice_id, version_id, is_latest, text, embedding) once, for any number of searches."""
    return Evidence(
        impact_index.build(chunks.select("chunk_id", "text"), "chunk_id"), metric_index.build(chunks.select("chunk_id", "embedding"), "chunk_id"),
        chunks.select("chunk_id", "notice_id", "version_id", "is_latest"), obligations, validity)


def find(messages: DataFrame, evidence: Evidence) -> tuple[DataFrame, DataFrame]:
    """Claims of messages (message_id, text, vector), and (message_id, claim_ix, notice_id, version_id): the first identity found for
    each claim that has an action, a deadline or an amount."""
    claims = written(C.extract_claims(messages), "claims")
    asked = claims.filter("coalesce(action.text, deadline.text, amount.text) is not null").select(
        (F.col("message_id") * 1000 + F.col("claim_ix")).alias("query_id"), "message_id", "claim_ix", "text")
    queries = written(asked.join(messages.select("message_id", "vector"), "message_id"), "queries")
    first = fusion.current_evidence(
        [fusion.lexical(evidence.words), fusion.dense(evidence.vectors)], queries.select("query_id", "text", "vector"), evidence.chunks,
        evidence.words.docs, 1)
    return claims, queries.join(first, "query_id").select("message_id", "claim_ix", "notice_id", "version_id")


def verdicts(messages: DataFrame, evidence: Evidence) -> DataFrame:
    """The verdict of each claim of messages (message_id, text, vector)."""
    claims, found = find(messages, evidence)
    return V.verify_claims(claims, evidence.obligations, evidence.validity, found)


def verifier(evidence: Evidence) -> Callable[[DataFrame], DataFrame]:
    """What :func:`herald.streaming.jobs.verify_stream` runs on each batch of messages: search, comparison, one verdict a message."""
    return lambda batch: V.message_verdicts(verdicts(batch, evidence))
