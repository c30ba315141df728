"""An index of pages by VIN and URL, so that lookups read no page bodies.

One pass over new pages writes a slim row per URL and per VIN that a page names, dealt to buckets by the
key's hash, sorted by key inside a file and with a Bloom filter per file.  A lookup reads the buckets of
the keys that are asked for; bodies are read again only for pages that somebody wants parsed.

Upkeep is by batches.  A batch's entries are written first and count once the batch's log (its pages)
is there, so a job that fails half-way leaves nothing that shows, and a repeated job overwrites its
own batch.  A page that comes again, or goes, replaces its earlier entries: the log's last batch decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lotweave.functions import web
from lotweave.operators.lookup import keep_wanted

BUCKETS = 32
ENTRY = "kind string, bucket int, key string, page_id long, url string, title string, domain string, is_supported boolean, batch int"
LOG = "page_id long, gone boolean, batch int"


def bucket_of(key, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def entries(pages: DataFrame) -> DataFrame:
    """(kind, key, page_id, url, title, domain, is_supported): an entry per URL and per VIN of each page (page_id, url, html).

    Pages without a usable URL have no entry under their VINs; null URLs none at all.
    """
    title = F.regexp_extract("html", r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1)
    vins = F.when(web.is_url(F.col("url")), F.array_distinct(web.vins_in(F.col("html"))))
    named = F.transform(F.coalesce(vins, F.array().cast("array<string>")), lambda v: F.struct(F.lit("vin").alias("kind"), v.alias("key")))
    own = F.filter(F.array(F.struct(F.lit("url").alias("kind"), F.col("url").alias("key"))), lambda e: e["key"].isNotNull())
    rows = pages.select(F.explode(F.concat(own, named)).alias("e"), "page_id", "url", title.alias("title"))
    rows = rows.select("e.kind", "e.key", "page_id", "url", "title").withColumn("domain", web.domain(F.col("url")))
    return rows.withColumn("is_supported", web.is_supported(F.col("domain")))


class PageIndex:
    """The index under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], schema)

    def add(self, pages: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Index new or changed pages and forget the `gone` ones (page_id), as one batch.

        A batch that is added again replaces itself.  A page_id that comes twice in a batch is one page
        with the entries of both rows.
        """
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        rows = entries(pages).distinct().withColumn("bucket", bucket_of(F.col("key"), self.buckets))
        dealt = rows.repartition(self.buckets, "bucket").sortWithinPartitions("kind", "bucket", "key", "page_id")
        # a batch without its log is invisible, so entries may be replaced while they are
        log = pages.select("page_id", F.lit(False).alias("gone"))
        if gone is not None:
            log = log.unionByName(gone.select("page_id", F.lit(True).alias("gone")))
        log = log.where("page_id IS NOT NULL").groupBy("page_id").agg(F.min("gone").alias("gone"))
        writer = dealt.select("kind", "bucket", "key", "page_id", "url", "title", "domain", "is_supported").write.mode("overwrite")
        writer.option("parquet.bloom.filter.enabled#key", "true").partitionBy("kind", "bucket").parquet(f"{self.path}/entries/batch={batch}")
        log.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def log(self) -> DataFrame:
        """The last word on each page: (page_id, batch, gone)."""
        rows = self._read("log", LOG)
        return rows.groupBy("page_id").agg(F.max("batch").alias("batch"), F.max_by("gone", "batch").alias("gone"))

    def find(self, kind: str, wanted: DataFrame | None = None) -> DataFrame:
        """Entries of a kind that hold, for the wanted keys (column key) or for all.

        Reads the wanted keys' buckets: the kind is a folder, and buckets are pruned by the join.
        """
        rows = self._read("entries", ENTRY).where(F.col("kind") == kind)
        if wanted is not None:
            keys = wanted.select("key").where("key IS NOT NULL").distinct().withColumn("bucket", bucket_of(F.col("key"), self.buckets))
            rows = rows.join(keys, ["bucket", "key"], "left_semi")
        return rows.join(self.log().where("NOT gone").select("page_id", "batch"), ["page_id", "batch"], "left_semi").drop("batch", "bucket", "kind")

    def compact(self, batch: int) -> None:
        """All entries that hold, rewritten as one later batch, so that lookups open few files."""
        live = self._read("entries", ENTRY).join(self.log().where("NOT gone").select("page_id", "batch"), ["page_id", "batch"], "left_semi")
        out = live.drop("batch").repartition(self.buckets, "bucket").sortWithinPartitions("kind", "bucket", "key", "page_id")
        out.write.mode("errorifexists").option("parquet.bloom.filter.enabled#key", "true").partitionBy("kind", "bucket").parquet(f"{self.path}/entries/batch={batch}")
        self.log().select("page_id", "gone").write.mode("errorifexists").parquet(f"{self.path}/log/batch={batch}")


def ranked(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """VIN entries with their rank per VIN: supported sites, then title, then page; the best `limit`, or all.

    Spark cuts by rank inside each task before the shuffle.
    """
    best = Window.partitionBy("vin").orderBy(F.desc("is_supported"), F.lower("title"), "page_id")
    rows = hits.withColumnRenamed("key", "vin").withColumn("rank", F.row_number().over(best))
    return rows if limit is None else rows.where(F.col("rank") <= limit)


def vin_pages(source: PageIndex | DataFrame, wanted: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Ranked pages of each (wanted) VIN, out of an index, or of a table of pages read for the purpose."""
    keys = None if wanted is None else wanted.select(F.col("vin").alias("key"))
    if isinstance(source, PageIndex):
        return ranked(source.find("vin", keys), limit)
    rows = entries(source).where("kind = 'vin'").drop("kind")
    return ranked(rows if keys is None else keep_wanted(rows, keys, "key"), limit)


def url_pages(source: PageIndex | DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, page_id) of the wanted URLs (column url) that have a page, the first page of each."""
    if isinstance(source, PageIndex):
        rows = source.find("url", wanted.select(F.col("url").alias("key"))).select("url", "page_id")
    else:
        rows = keep_wanted(source.select("url", "page_id"), wanted, "url")
    return rows.groupBy("url").agg(F.min("page_id").alias("page_id"))
