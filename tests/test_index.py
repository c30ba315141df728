"""The page index: lookups without bodies, batches that replace and forget, jobs that fail or run twice."""

import pytest
from pyspark.sql import functions as F

from lotweave.plans import pipeline, suggest
from lotweave.sources import pages as P
from lotweave.sources.index import PageIndex, entries, url_pages, vin_pages

VIN, OTHER = "1HGCM82633A004352", "5YJSA1E26HF000337"


def page(spark, *rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def text(*vins):
    return "<title> Car </title>" + " ".join(vins)


@pytest.fixture
def index(spark, tmp_path):
    made = PageIndex(spark, str(tmp_path / "index"), buckets=4)
    made.add(page(spark, (1, "https://a.com/1", text(VIN)), (2, "https://www.cars.com/2", text(VIN, OTHER)), (3, None, text(OTHER)), (4, "bad url", text(VIN)), (5, "https://a.com/5", None)), 0)
    return made


def vins(index, *wanted):
    spark = index.spark
    asked = spark.createDataFrame([(v,) for v in wanted], "vin string") if wanted else None
    return {v: [r["page_id"] for r in sorted(rows, key=lambda r: r["rank"])] for v, rows in _by(vin_pages(index, asked).collect(), "vin").items()}


def _by(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def urls(index, *wanted):
    asked = index.spark.createDataFrame([(u,) for u in wanted], "url string")
    return {r["url"]: r["page_id"] for r in url_pages(index, asked).collect()}


def test_lookups_equal_those_over_pages(spark, index):
    assert vins(index) == {VIN: [2, 1], OTHER: [2]} and vins(index, OTHER, "x", None) == {OTHER: [2]}
    assert urls(index, "https://a.com/1", "https://a.com/5", "bad url", "https://none.com/") == {"https://a.com/1": 1, "https://a.com/5": 5, "bad url": 4}
    got = {r["url"]: (r["page_id"], r["error"]) for r in P.fetch_urls(spark.createDataFrame([("https://a.com/1",), ("bad url",), ("https://no.com/",)], "url string"), index).collect()}
    assert got == {"https://a.com/1": (1, None), "bad url": (None, P.INVALID_URL), "https://no.com/": (None, P.NOT_FOUND)}


def test_changed_and_gone_pages(spark, index):
    index.add(page(spark, (1, "https://a.com/1", text(OTHER)), (6, "https://a.com/6", text(VIN))), 1, gone=spark.createDataFrame([(2,)], "page_id long"))
    assert vins(index) == {VIN: [6], OTHER: [1]}
    assert urls(index, "https://www.cars.com/2", "https://a.com/6") == {"https://a.com/6": 6}
    index.add(page(spark, (2, "https://www.cars.com/2", text(VIN))), 2)  # it comes back
    assert vins(index) == {VIN: [2, 6], OTHER: [1]}
    index.compact(3)
    assert vins(index) == {VIN: [2, 6], OTHER: [1]}
    files = index._read("entries", "batch int").where("batch = 3").count()
    assert files == len(entries(page(spark, (2, "https://www.cars.com/2", text(VIN)), (6, "https://a.com/6", text(VIN)), (1, "https://a.com/1", text(OTHER)))).collect()) + 2  # urls of 4 and 5
    index.add(page(spark, (6, "https://a.com/6", "")), 4)
    assert vins(index, VIN) == {VIN: [2]}


def test_a_batch_without_its_log_is_invisible_and_a_repeated_one_replaces_itself(spark, index):
    before = vins(index)
    rows = entries(page(spark, (9, "https://a.com/9", text(VIN)))).withColumn("bucket", F.lit(0))
    rows.write.partitionBy("kind", "bucket").parquet(f"{index.path}/entries/batch=1")  # a job that ended before its log
    assert vins(index) == before
    for _ in range(2):
        index.add(page(spark, (9, "https://a.com/9", text(VIN))), 1)
        assert vins(index) == {VIN: [2, 1, 9], OTHER: [2]}


def test_an_empty_index_and_empty_batches(spark, tmp_path):
    made = PageIndex(spark, str(tmp_path / "new"))
    assert vins(made) == {} and urls(made, "https://a.com/") == {}
    made.add(spark.createDataFrame([], "page_id long, url string, html string"), 0)
    assert vins(made) == {}
    with pytest.raises(ValueError):
        made.add(spark.createDataFrame([], "page_id long, url string, html string"), -1)


def test_no_lookup_reads_bodies(spark, index):
    asked = spark.createDataFrame([(VIN,)], "vin string")
    requests = pipeline.typed_requests(spark.createDataFrame([(1, VIN), (2, "https://a.com/1")], "request_id long, input_value string"))
    for df in (vin_pages(index, asked), pipeline.candidates(requests, index), P.fetch_urls(asked.withColumnRenamed("vin", "url"), index)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "html" not in plan and "kind" in plan and "PartitionFilters" in plan


def test_suggestions_for_urls(spark, index):
    pages = page(spark, (1, "https://a.com/1", f"<b class='price'>$5</b><p>{VIN}</p>"), (2, "https://www.cars.com/2", "<p>x</p>"))
    asked = spark.createDataFrame([("https://a.com/1",), ("https://a.com/1",), ("https://www.cars.com/2",), ("https://none.com/",), ("what",), (None,)], "url string")
    got = {r["url"]: r for r in suggest.for_urls(asked, pages, pages).collect()}
    assert {k: (r["success"], r["error"]) for k, r in got.items()} == {
        "https://a.com/1": (True, None), "https://www.cars.com/2": (True, None),
        "https://none.com/": (False, "Failed to fetch URL: not in corpus"), "what": (False, "Failed to fetch URL: Invalid URL format"),
    }
    assert {x["field"] for x in got["https://a.com/1"]["ranked"]} == {"price", "vin"} and got["https://a.com/1"]["coverage"] == 2 / 13
    assert got["what"]["ranked"] == [] and got["what"]["coverage"] == 0.0
