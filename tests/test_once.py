"""Work that a plan must do once per row, and where: what rows cost decides whether a corpus fits."""

import re

from lotweave.constants import FIELD_DICTIONARY
from lotweave.operators.dom import with_dom
from lotweave.plans import model, pipeline, suggest
from lotweave.registry import QUERIES
from lotweave.registry.corpus import listings

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_answer_is_parsed_once_where_only_good_ones_are_asked_for(spark):
    for name in ("response_clean", "goal_metadata"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert plan.count("parseJson") == 1, name
        # above the dealing of listings, not in the join that makes them
        assert plan.index("parseJson") < plan.index("RepartitionByExpression"), name


def test_a_mark_is_read_once_for_all_keywords(spark, pages):
    found = suggest.by_keyword([(d[0], d[4]) for d in FIELD_DICTIONARY])
    plan = plan_of(with_dom(pages("<p>x</p>")).select(found.alias("found")))
    assert not re.search(r"exists\(regexp_extract_all", plan)


def test_a_page_is_mapped_once(spark):
    for name in ("map_fields", "map_confidence", "preview_fields", "preview_summary", "compare_fields"):
        assert plan_of(QUERIES[name](spark, SF)).count("ArrowEvalPython [_swept(") == 1, name


def test_what_is_read_twice_is_made_once(spark):
    assert "MapInArrow" not in plan_of(QUERIES["overall_similarity"](spark, SF))
    assert plan_of(QUERIES["schema_results"](spark, SF)).count("RepartitionByExpression") == 1


def test_candidates_stay_in_the_page_row(spark):
    for name in ("suggest_rank", "suggest_all", "suggest_model"):
        plan = plan_of(QUERIES[name](spark, SF))
        # nothing joins above the tree: answers meet the page below it
        assert "Join" not in plan[: plan.index("MapInArrow")], name


def test_an_answer_is_parsed_only_for_a_page_that_asks_for_it(spark):
    for name in ("parse_pipeline", "corpus_yield"):
        plan = plan_of(QUERIES[name](spark, SF))
        # above the join of answers with the weak pages, not below it for all answers
        assert plan.count("parseJson") == 1 and plan.index("parseJson") < plan.index("Join LeftOuter"), name


def test_a_request_is_typed_once(spark):
    df = QUERIES["trace_output"](spark, SF)
    assert any("/asked-" in f for f in df.inputFiles()) and "RLIKE" not in plan_of(df)


def test_answers_as_they_came_give_what_parsed_ones_give(spark, pages):
    strong = "<h1>2020 Kia Rio</h1><p>VIN: 1HGCM82633A004352</p><p>Price: $9,500</p>"
    table = pages(strong, "<p>x</p>", "<p>y</p>", "<p>z</p>", "<p>q</p>", url="https://x.com/1")
    answer = '{"make": "Kia", "model": "Rio", "year": 2020}'
    rows = [(0, answer), (1, answer), (1, '{"make": "Seat"}'), (2, "Sorry"), (3, None), (None, answer), (9, answer)]
    given = spark.createDataFrame(rows, "page_id long, response string")
    registry = pipeline.parser_registry(spark)
    raw, parsed = (pipeline.parse_pages(table, registry, a) for a in (given, model.parse_answers(given)))
    assert raw.columns == parsed.columns
    got = sorted(map(str, raw.collect()))
    assert got == sorted(map(str, parsed.collect()))
    assert sorted((r.page_id, r.success, r.vehicle and r.vehicle.make) for r in raw.collect() if r.page_id != 0 and r.page_id < 3) == [
        (1, True, "Kia"), (1, True, "Seat"), (2, False, None)]


def test_listings_are_dealt_before_they_are_computed(spark):
    plan = plan_of(listings(spark, SF))
    assert plan.index("md5") < plan.index("RepartitionByExpression") < plan.index("Join")
    assert plan_of(listings(spark, SF)).count("md5") == 1
