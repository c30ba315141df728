"""What grows with the corpus never passes through the driver, however few bytes the planner takes it for."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lotweave.plans import compare, model, suggest
from lotweave.registry import QUERIES
from lotweave.registry.corpus import listings

SF = "/root/testdata/sf0.001"
BROADCAST = re.compile(r"BroadcastHashJoin \[(?:page_id|site_id|FLOOR)")


def ran(df):
    """The rows, and the plan that made them: what was broadcast once sizes were known shows there only."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan
    return rows, plan


def said(spark):
    """Parsed answers: a page with two, one with a failed one, one of no page and one without a key."""
    rows = [(0, '{"vin": "v"}'), (0, '{"vin": "w"}'), (2, "Sorry"), (7, '{"vin": "x"}'), (None, '{"vin": "y"}')]
    return model.parse_answers(spark.createDataFrame(rows, "page_id long, response string"))


def test_no_side_of_the_listings_is_broadcast(spark, tmp_path):
    spark.range(40).selectExpr("id AS p_partkey", "'red car' AS p_name", "'Brand#1' AS p_brand", "'T' AS p_type", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name", "0 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name").write.parquet(f"{tmp_path}/nation.parquet")
    rows, plan = ran(listings(spark, str(tmp_path)).select("listing_id", "dealer_name"))
    assert sorted(rows) == [(k, f"s{k // 20}") for k in range(40)]
    assert not BROADCAST.search(plan)


def test_answers_are_not_broadcast_to_compared_pages(spark):
    found = F.struct(F.lit("vin").alias("field"), F.lit("v").alias("value"), F.lit(False).alias("is_list"), F.lit(True).alias("success"), F.array(F.lit("v")).alias("values"))
    previews = spark.range(3).select(
        F.col("id").alias("page_id"), F.when(F.col("id") != 1, F.array(found)).alias("fields"), F.array(F.lit("lost")).alias("errors"), F.lit(0.5).alias("confidence"))
    rows, plan = ran(compare.pair_up(previews, said(spark)))
    got = [(r.page_id, r.mapping and len(r.mapping), r.model and r.model[0].value, r.mapping_error, r.model_error) for r in rows]
    assert sorted(got, key=str) == [(0, 1, "v", None, None), (0, 1, "w", None, None), (1, None, None, "lost", None), (2, 1, None, None, model.PARSE_ERROR)]
    assert not BROADCAST.search(plan)


def test_answers_are_not_broadcast_to_pages(spark, pages):
    rows, plan = ran(suggest.with_answers(pages("a", "b", "c"), said(spark)))
    got = [(r.page_id, r.html, r.given and r.given[0].value) for r in rows]
    assert sorted(got, key=str) == [(0, "a", "v"), (0, "a", "w"), (1, "b", None), (2, "c", None)]
    assert not BROADCAST.search(plan)


def test_neither_pages_nor_weak_fields_are_broadcast(spark, pages):
    rows = [(0, "vin", "missing", 0.0, "s"), (0, "price", "different", 0.5, None), (0, "make", "match", 1.0, None), (1, "year", "different", 0.8, "t"), (5, "vin", "missing", 0.0, "u")]
    judged = spark.createDataFrame(rows, "page_id long, field string, difference_type string, similarity double, suggestion string")
    rows, plan = ran(suggest.with_weak(pages("a", "b", "c"), judged))
    assert [(r.page_id, r.html, sorted(w.field for w in r.weak)) for r in rows] == [(0, "a", ["price", "vin"])]
    assert not BROADCAST.search(plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", [
    "compare_fields", "field_union", "coverage", "improvements", "suggest_all", "recommendations", "suggest_coverage", "suggest_model",
    "suggest_rank", "suggest_validate"])
def test_sizes_choose_no_join_of_pages(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    met = [line for line in plan.splitlines() if re.search(r"Join \w+, .*\bpage_id#\d+L? = page_id#", line)]
    assert met and all("strategy=merge" in line for line in met)
    assert plan.count("strategy=merge") == len(met) + plan.count("RepartitionByExpression [listing_id")
