"""Bounded samples of labelled rows, for the classifiers that learn on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossrank.llm.common import fold


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, rows: int) -> DataFrame:
    """``doc_id, text, y`` of at most ``rows`` labelled documents outside the held-out fold.

    The ids with the least hash are chosen from the labels alone, so texts are read for the sample only, and the
    broadcast side has at most ``rows`` rows. Of contradictory labels of one id the larger counts; of documents that
    share an id one is learned from, the one with the least hash of its text.
    """
    named = labels.filter(F.col(label).isNotNull() & (fold("doc_id", modulus) != held_out) & F.col("doc_id").isNotNull())
    chosen = named.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("doc_id", "text", "y")
