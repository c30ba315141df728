"""Plans don't grow with the number of partitions or label values."""

import pytest
from pyspark.sql import functions as F

from lotweave.llm import language, minhash
from lotweave.llm.common import stratified

SF = "/root/testdata/sf0.001"


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4000")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_minhash_plans_for_thousands_of_partitions(spark, many_partitions):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    ring, _ = minhash._ring(docs)
    assert len(ring.heads) > 3000
    plan = minhash.near_edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000 and "CASE" not in plan


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_minhash_order_with_null_and_repeated_ids(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = [(i if i % 3 else None, f"text number {i} " * (i % 5)) for i in range(200)] + [(400, "x y"), (400, "x z")]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        order = sorted(hashed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"], r["text"]))
        want = sorted((str(r["doc_id"]), len(r["text"]), minhash.edited(r["text"], n["text"])) for r, n in zip(order, [*order[1:], order[0]]))
        dealt = minhash.beside_next(docs).collect()
        assert sum(r["extra"] == 0 for r in dealt) == len(rows)
        got = minhash.near_edits(docs).collect()
        digests = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got)
        assert digests == sorted((i, n, __import__("hashlib").sha256(t.encode()).hexdigest()) for i, n, t in want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_language_learns_from_a_column_of_thousands_of_values(spark):
    docs = spark.range(12_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise(F.concat(F.lit("value"), (F.col("id") % 10_000).cast("string"))).alias("lang"),
    )
    rows = language.labelled(docs, 50)
    assert len({lang for _, lang in rows}) == language.LANGUAGES and len(rows) < 2 * language.LANGUAGES + 100
    assert language.identify(docs.filter("doc_id < 40")).count() == 40
    assert language.with_language(docs).filter("doc_id < 40").count() >= 0


def test_stratified_counts_and_determinism(spark):
    rows = spark.range(9000).select(F.col("id").alias("k"), F.when(F.col("id") % 9 == 0, "b").when(F.col("id") % 100 == 1, None).otherwise("a").alias("y"))
    one, two = (sorted(r["k"] for r in stratified(rows.repartition(n), "y", 500, "s", "k").collect()) for n in (1, 5))
    assert one == two and 850 < len(one) < 1150
    assert stratified(rows.limit(0), "y", 5, "s", "k").collect() == []
