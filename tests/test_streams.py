"""Streams: answers that come early, late or never; first success over tries in any order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lotweave.plans import pipeline
from lotweave.streaming import answers as late
from lotweave.streaming import intake, tries

T0 = dt.datetime(2026, 1, 1, 12)
WEAK, STRONG = "<h1>Something</h1><p>no facts</p>", (
    "<h1>2020 Kia Rio</h1><p>VIN: 5TDGZRBHXMS103005</p><p>Price: $9,000</p><p>12,000 miles</p><p>Call (555) 123-4567</p>"
)
ANSWER = '{"vin": "5TDGZRBHXMS103005", "make": "Kia", "model": "Rio", "year": 2020}'


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_early_late_and_missing_answers(spark, tmp_path):
    folders = {k: str(tmp_path / k) for k in ("pages", "answers", "state")}
    written = {"n": 0}

    def put(kind, rows, schema):
        written["n"] += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folders[kind]}/{written['n']}")

    def pages(*rows):
        put("pages", [(i, f"https://x.com/{i}", html, at(m)) for i, html, m in rows], intake.PAGE_SCHEMA)

    def answers(*rows):
        put("answers", [(i, "m", 1, text, at(m)) for i, text, m in rows], late.ANSWER_SCHEMA)

    pages((1, WEAK, 0), (2, WEAK, 0), (3, STRONG, 0), (4, WEAK, 1))
    answers((1, ANSWER, -5), (1, ANSWER, -4), (3, ANSWER, 0))  # one before its page, one twice, one that nobody needs
    registry = pipeline.parser_registry(spark)
    page_rows = spark.readStream.schema(intake.PAGE_SCHEMA).option("recursiveFileLookup", "true").parquet(folders["pages"])
    given = spark.readStream.schema(late.ANSWER_SCHEMA).option("recursiveFileLookup", "true").parquet(folders["answers"])
    given = given.withWatermark("answered_at", "10 minutes").dropDuplicatesWithinWatermark(["page_id"])
    out = late.goals_of(late.with_late_answers(page_rows, given, registry, wait="20 minutes", early="20 minutes"))
    query = out.writeStream.format("memory").queryName("late_answers").option("checkpointLocation", folders["state"]).start()

    def now():
        query.processAllAvailable()
        return {r["page_id"]: (r["parser_used"], r["success"]) for r in spark.table("late_answers").collect()}

    try:
        assert now() == {1: ("ai-assisted", True), 3: ("generic", True)}
        answers((2, ANSWER, 15))
        assert now()[2] == ("ai-assisted", True)
        answers((4, "no answer at all", 16))  # an answer that fails is no answer, but ends the wait
        assert now()[4] == ("generic", False)
        pages((5, WEAK, 20), (6, STRONG, 300))
        answers((5, ANSWER, 90), (6, ANSWER, 300))  # too late for 5
        pages((7, STRONG, 301))
        answers((7, ANSWER, 301))
        got = now()
        assert got[5] == ("generic", False) and got[7] == ("generic", True) and len(got) == 7
        assert spark.table("late_answers").count() == 7
    finally:
        query.stop()


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_first_success_in_any_order_of_arrival(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = []
    for request in range(25):
        n = rng.randint(1, 5)
        known = n if rng.random() < 0.7 else None
        for rank in range(1, n + 1):
            ok = rng.random() < 0.3
            rows.append((request, rank, known, request * 10 + rank, f"u{rank}", ok, None if ok else f"e{rank}", at(rng.randint(0, 5))))
    shuffled = rows[:]
    rng.shuffle(shuffled)
    for k in range(3):
        part = shuffled[k::3]
        spark.createDataFrame(part, tries.TRIES).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(tries.TRIES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = tries.first_successes(stream, wait_seconds=1800, delay="10 minutes")
    query = out.writeStream.format("memory").queryName("first_tries").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        early = {r["request_id"] for r in spark.table("first_tries").collect()}
        last = [(900 + i, 1, 1, None, None, False, "x", at(200 + i)) for i in range(2)]
        for k, row in enumerate(last):
            spark.createDataFrame([row], tries.TRIES).coalesce(1).write.parquet(f"{tmp_path}/in/late{k}")
            query.processAllAvailable()
        # a try that comes after its answer changes nothing
        got = {r["request_id"]: r for r in spark.table("first_tries").collect()}
        batch = spark.createDataFrame(rows, tries.TRIES)
        want = {r["request_id"]: r for r in pipeline.first_success(batch, "rank", "success", "page_id", "error").collect()}
        assert got.keys() - {900, 901} == want.keys() and spark.table("first_tries").count() == len(got)
        for k, w in want.items():
            assert (got[k]["rank"], got[k]["success"], got[k]["page_id"], got[k]["error"]) == (w["rank"], w["success"], w["page_id"], w["error"])
        forced = {k for k, r in got.items() if not r["complete"]}
        assert early and not early & forced and all(not got[k]["success"] for k in forced)
    finally:
        query.stop()


def test_registered_first_success_is_the_batch_counterpart(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False)]
    table = spark.createDataFrame(rows, "request_id long, rank int, success boolean")
    got = {r["request_id"]: (r["rank"], r["success"]) for r in pipeline.first_success(table, "rank", "success").collect()}
    assert got == {1: (2, True), 2: (2, False)}
