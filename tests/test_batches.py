"""Sinks and rollups by batch: repeated, failed and split jobs give what one run over all gives."""

import pytest
from pyspark.sql import functions as F

from lotweave.functions.values import modal_price
from lotweave.plans import pipeline, rollup, schemas
from lotweave.registry import corpus
from lotweave.registry.jobs import answers
from lotweave.sources.sink import OnceSink

SF = "/root/testdata/sf0.001"
ROW = "request_id long, body string"


@pytest.fixture
def sink(spark, tmp_path):
    return OnceSink(spark, str(tmp_path / "cases"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROW)


def held(sink):
    got = [(r["request_id"], r["body"]) for r in sink.read(ROW).collect()]
    assert len(got) == len(set(k for k, _ in got))
    return dict(got)


def test_a_repeated_job_adds_nothing(spark, sink):
    assert held(sink) == {}
    sink.write(rows(spark, (1, "a"), (2, "b"), (2, "b")), 0)
    assert held(sink) == {1: "a", 2: "b"}
    sink.write(rows(spark, (1, "changed"), (3, "c")), 1)  # the job again, with one request more
    sink.write(rows(spark, (1, "again")), 2)
    assert held(sink) == {1: "a", 2: "b", 3: "c"}
    sink.write(rows(spark, (3, "c2"), (4, "d")), 1)  # the same batch once more replaces itself
    assert held(sink) == {1: "a", 2: "b", 3: "c2", 4: "d"}
    assert sink.manifest().where("file IS NULL OR NOT file LIKE 'part-%'").count() == 0


def test_a_job_that_ends_before_its_manifest_shows_nothing(spark, sink):
    sink.write(rows(spark, (1, "a")), 0)
    rows(spark, (7, "lost"), (1, "b")).write.json(f"{sink.path}/rows/batch=1")
    assert held(sink) == {1: "a"}
    sink.write(rows(spark, (7, "there"), (1, "b")), 1)
    assert held(sink) == {1: "a", 7: "there"}


def test_rows_without_a_key_are_refused(spark, sink):
    with pytest.raises(Exception, match="without request_id"):
        sink.write(rows(spark, (None, "x")), 0)
    with pytest.raises(ValueError):
        sink.write(rows(spark, (1, "x")), -1)


def test_yield_of_three_batches_is_that_of_one_run(spark, tmp_path):
    pages = corpus.listing_pages(spark, SF)
    registry, given = pipeline.parser_registry(spark), answers(spark, SF)
    kept = rollup.Rollup(spark, str(tmp_path / "yield"), rollup.YIELD_STATE)
    assert rollup.merged_yield(kept.states()).collect() == []
    for batch in range(3):
        kept.put(rollup.yield_state(pipeline.parse_pages(pages.where(F.col("page_id") % 3 == batch), registry, given)), batch)
    kept.put(rollup.yield_state(pipeline.parse_pages(pages.where("page_id % 3 = 1"), registry, given)), 1)  # again
    whole = sorted(map(tuple, pipeline.corpus_yield(pipeline.parse_pages(pages, registry, given)).collect()))
    assert sorted(map(tuple, rollup.merged_yield(kept.states()).collect())) == whole and whole
    part = rollup.merged_yield(kept.states(1, 1))
    assert 0 < part.agg(F.sum("pages")).first()[0] < sum(r[2] for r in whole)
    assert "PartitionFilters: [isnotnull(batch" in kept.states(1, 1)._jdf.queryExecution().executedPlan().toString()


def test_success_rates_merge(spark, tmp_path):
    results = spark.createDataFrame([(f"s{i % 3}", i % 4 != 0) for i in range(40)], "site_id string, success boolean")
    kept = rollup.Rollup(spark, str(tmp_path / "rates"), rollup.RATE_STATE)
    for batch, part in enumerate(results.randomSplit([0.5, 0.3, 0.2], seed=1)):
        kept.put(rollup.rate_state(part), batch)
    assert sorted(map(tuple, rollup.merged_rates(kept.states()).collect())) == sorted(map(tuple, schemas.success_rates(results).collect()))


@pytest.mark.parametrize(("prices", "want"), [([], None), ([5], 5), ([3, 5, 5, 3], 3), ([1, 2, 2, 9], 2), ([9, 8, 8, 9, 7], 9), (list(range(3000)) + [7], 7)])
def test_modal_price(spark, prices, want):
    assert spark.createDataFrame([(prices,)], "p array<int>").select(modal_price(F.col("p"))).first()[0] == want
