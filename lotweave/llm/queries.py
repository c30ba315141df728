"""One query per operator, over its whole table with production parameters, and SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm import bpe, language, minhash, mixing, negatives, orchard, pieces, pstable, quality, simhash, surrogates, toxicity, urls
from lotweave.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pstable.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0), neighbours=20)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", "mix_rate", "mix_copy", "mix_key")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(table(spark, sf_dir, "documents")).select("doc_id", "text", "pii_count", "pii_kinds")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_edits(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.cluster(table(spark, sf_dir, "embeddings")).drop("compared")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return negatives.mine(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


_ALL = (
    op1_pstable, op2_simhash, op3_mixing, op4_toxicity, op5_language, op6_surrogates, op7_bpe, op8_urls, op9_minhash, op10_quality,
    op11_orchard, op12_pieces, op13_negatives,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLES: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op11_orchard": orchard.ORACLE, "op13_negatives": negatives.ORACLE}
