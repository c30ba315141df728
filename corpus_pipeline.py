"""Corpus pipeline over `documents`: language, near-duplicates, personal data, mixing, token ids.

Each stage takes what the one before kept, written as Parquet and read again, and returns the columns
of documents; the last returns token counts and digests.  Stages decide on their own input only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotweave.llm import bpe, language, mixing, simhash, surrogates
from lotweave.llm.common import DOCUMENT_COLUMNS, stored, table
from lotweave.session import tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _documents(docs: DataFrame) -> DataFrame:
    tune(docs.sparkSession)  # batches of bounded size to Python
    return docs.select(*DOCUMENT_COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows, lang as predicted; other texts, and those without letters, go."""
    return language.with_language(_documents(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at few differing bits, that of the least doc_id."""
    return simhash.one_of_each(_documents(docs))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text."""
    return surrogates.without_personal_data(_documents(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight and a Poisson draw say, in random order."""
    return mixing.replicate(_documents(docs)).select(*DOCUMENT_COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, a row per copy."""
    return bpe.round_trip(_documents(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("surrogates", personal_data_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", token_stage),
]

#: SQL can express neither the trained language model nor the encoder: tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
