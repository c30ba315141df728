"""VIN search over a corpus of hits: URL filter, ranking, top-n and fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotweave.constants import TOP_URLS
from lotweave.functions import web


def _described(hits: DataFrame) -> DataFrame:
    dom = web.domain(F.col("href"))
    return hits.where(web.is_url(F.col("href"))).withColumn("domain", dom).withColumn(
        "is_supported", web.is_supported(F.col("domain"))
    )


def rank_hits(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Usable hits in order: supported sites first, then by title, ties as found; the best ``limit``, or all.

    Ranks are taken over all usable hits and cut last; with a limit Spark prunes before the shuffle.
    """
    order = Window.partitionBy("vin").orderBy(F.desc("is_supported"), F.lower("title"), "seq")
    ranked = _described(hits).withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def top_urls(hits: DataFrame, n: int = TOP_URLS) -> DataFrame:
    return rank_hits(hits, n).select("vin", "rank", F.col("href").alias("url"))


def with_fallback(hits: DataFrame, fallback: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranked hits; VINs without any take the fallback's, as found (its first ``limit``, or all)."""
    main = rank_hits(hits, limit).select("vin", "rank", "href", F.lit("main").alias("source"))
    order = Window.partitionBy("vin").orderBy("seq")
    spare = (
        _described(fallback)
        .join(main.select("vin").distinct(), "vin", "left_anti")
        .select("vin", F.row_number().over(order).alias("rank"), "href", F.lit("fallback").alias("source"))
    )
    return main.unionByName(spare if limit is None else spare.where(F.col("rank") <= limit))
