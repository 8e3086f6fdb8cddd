"""A corpus pipeline: documents in, packed training sequences out.

Each stage is written and read again before the next. A stage takes ``(spark, docs, sf_dir)`` and works on all
rows that the stage before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossrank.llm import jaccard, language, packing, pii, substrings
from crossrank.llm.common import fresh, table, written


def _measured(new: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return new.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in new.columns else new


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null or empty texts, and texts without a letter.

    Without any named language to learn from, no text has a language and all are dropped. Repeated rows and null ids
    are judged by their own text. Of equally likely languages the first by name is taken, which drops none.
    """
    label, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return language.identify(docs, label, score).filter(F.col(label) != "und").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of near-duplicates.

    All rows of the least id stay, repeated ones too; rows with a null id belong to no group and stay; empty texts are
    near to nothing and stay.
    """
    extra = jaccard.groups(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated word windows out of the texts of larger ids.

    Rows of equal ids take nothing from each other; a null id counts as the largest; texts that lose nothing, null or
    empty ones among them, stay as they were; a text that loses all its words stays as an empty one.
    """
    return _measured(substrings.without_repeats(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, each stretch of overlapping spans by that of its first span.

    Of spans that start together the kind listed first counts. Null texts stay null; no row is dropped.
    """
    return _measured(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as the packing query returns them.

    A null or empty text is a piece of the end id alone; each repeated row has pieces of its own.
    """
    return packing.pieces(docs)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("substrings", without_repeated_passages),
    ("pii", without_personal_data),
    ("packing", packed),
]

#: Tokenizing, learned languages and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
