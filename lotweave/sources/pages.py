"""Page corpora as sources: files, and lookup of requested URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.functions import web
from lotweave.sources.index import PageIndex, url_pages

INVALID_URL = "Invalid URL format"
NOT_FOUND = "not in corpus"


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of saved pages, one file per page."""
    url = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "file:///")
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html")
    )


def fetch_urls(urls: DataFrame, pages: PageIndex | DataFrame) -> DataFrame:
    """One row per distinct URL: the first page it names, in a table of pages or its index, or why there is none."""
    wanted = urls.select("url").where(F.col("url").isNotNull()).distinct()
    return with_fetch_error(wanted.join(url_pages(pages, wanted), "url", "left"))


def with_fetch_error(found: DataFrame) -> DataFrame:
    error = F.when(~web.is_url(F.col("url")), F.lit(INVALID_URL)).when(
        F.col("page_id").isNull(), F.lit(NOT_FOUND)
    )
    return found.select(
        *[c for c in found.columns if c != "page_id"],
        F.when(error.isNull(), F.col("page_id")).alias("page_id"),
        error.isNull().alias("success"),
        error.alias("error"),
    )


def fetch_requests(requests: DataFrame, pages: PageIndex | DataFrame) -> DataFrame:
    """One row per request (request_id, url).

    Each URL is looked up once; a URL asked for by a third of all requests meets a slim one-row
    side, which AQE splits.
    """
    results = fetch_urls(requests, pages)
    return requests.join(results, "url", "left").select(
        *requests.columns, "page_id",
        F.coalesce("success", F.lit(False)).alias("success"),
        F.when(F.col("url").isNull(), F.lit(INVALID_URL)).otherwise(F.col("error")).alias("error"),
    )


def page_report(pages: DataFrame, with_html: bool = False, limit: int | None = None) -> DataFrame:
    """Size, validity and type of each page, on request with its body (its first ``limit`` characters)."""
    html = F.col("html")
    cols = [
        F.length(html).alias("html_size"),
        web.page_valid(html).alias("is_valid"),
        web.has_vehicle_data(html).alias("has_vehicle_data"),
        web.has_vehicle_data(html).alias("is_listing"),
        F.lit(False).alias("is_error"),
        web.domain_marks(html).alias("domain_indicators"),
    ]
    if with_html:
        cols.append(html if limit is None else F.substring(html, 1, limit).alias("html"))
    return pages.select("page_id", "url", *cols)
