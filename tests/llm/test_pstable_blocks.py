"""Cells of op1_pstable hold a bounded number of queries; cutting changes no result and copies nothing elsewhere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotweave.llm import pstable


@pytest.fixture(scope="module")
def table(spark):
    v = np.random.default_rng(3).normal(size=(300, 6))
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").cache()


@pytest.mark.parametrize("probes", [1, 60])  # 1: most queries are completed against all rows
def test_query_blocks_change_nothing(table, probes):
    whole, cut = (sorted(map(tuple, pstable.search(table, table, 20, probes=probes, queries_held=n).collect())) for n in (10**6, 20))
    assert [r[:3] for r in whole] == [r[:3] for r in cut] and len(cut) == 300 * 20


def test_no_cell_holds_all_queries_and_all_meet(table):
    classes = table.selectExpr("vec_id as rep", "embedding as v")
    held, wanted, _ = pstable._buckets(classes, classes, 6, 6.0, 8, 4, 1.0, 60, 4096, 20)
    assert max(r["count"] for r in wanted.groupBy("cell").count().collect()) <= 120
    here, there = (df.select(F.col("rep").alias(name), F.explode("buckets").alias("bucket")) for df, name in ((wanted, "rep"), (held, "candidate")))
    met = here.join(there, "bucket").select("rep", "candidate").distinct().count()
    assert met > 0.9 * 300 * 300


def test_candidates_are_not_copied_for_queries_of_other_buckets(spark):
    """Twenty times as many queries, all in a bucket of their own: the other candidates stay as they were."""
    rng = np.random.default_rng(5)
    far = [(i, (rng.normal(size=6) * 0.01 + [1, 0, 0, 0, 0, 0]).tolist()) for i in range(200)]
    near = [(1000 + i, (rng.normal(size=6) * 0.01 + [-1, 0, 0, 0, 0, 0]).tolist()) for i in range(400)]
    rows = spark.createDataFrame(far + near, "rep long, v array<double>")
    counts = []
    for asked in (20, 400):
        held, _, _ = pstable._buckets(rows, rows.filter(f"rep < 5 or rep between 1000 and {1000 + asked - 1}"), 6, 1.1, 8, 4, 1.0, 4, 4096, 20)
        counts.append(held.filter("rep < 200").count())
    assert counts[0] == counts[1]


def test_slices_of_all_rows_give_the_nearest(table):
    classes = table.selectExpr("vec_id as rep", "embedding as v")
    got = pstable._against_all(classes, classes.filter("rep < 40"), 6, 5, slice_rows=17).collect()
    v = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()])
    for q in range(40):
        score = v @ v[q]
        best = sorted(((-r["score"], r["class"]) for r in got if r["query"] == q))[:5]
        want = np.lexsort((np.arange(300), -score))[:5]
        assert [c for _, c in best] == want.tolist()


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)] + [(400 + i, (x / np.linalg.norm(x) / 2).tolist()) for i, x in enumerate(rng.normal(size=(800, 4)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    plan = table.distinct()
    by = pstable.Window.partitionBy("embedding").orderBy("vec_id")
    text = plan.withColumn("k", F.row_number().over(by)).filter("k <= 21")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text  # each task keeps the least before rows move
    got = pstable.search(table, table.filter("vec_id = 390"), 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(20))
