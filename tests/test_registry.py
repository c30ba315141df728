"""Registered queries against their SQL.  LOTWEAVE_ALL=1 runs every one, else one per kind of plan."""

import os

import pytest

from lotweave.registry import ORACLES, QUERIES
from tests.check import compare

SF = os.environ.get("LOTWEAVE_SF", "/root/testdata/sf0.001")
SOME = ["url_domain", "goal_json", "dom_nodes", "page_text", "select_xpath", "site_extract", "generic_extract", "map_goal", "preview_fields",
        "preview_summary", "compare_fields", "overall_similarity", "recommendations", "suggest_rank", "suggest_model", "suggest_keyword",
        "search_rank", "search_fallback", "rules_info", "rules_validate", "config_validate", "schema_list", "schema_create", "schema_update",
        "schema_results", "schema_test", "schema_requests", "sites_list", "suggest_url", "suggest_all", "preview_documents", "vin_pages", "vin_unmatched", "pipeline_vin", "response_clean", "case_requests"]
NAMES = sorted(ORACLES) if os.environ.get("LOTWEAVE_ALL") else SOME


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name]) == ""


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", ["site_extract", "generic_extract", "map_confidence"])
def test_page_work_has_no_shuffle_after_the_tree(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # rules, and the slim listings that pages are made of: never pages
    assert all("hashpartitioning(site_id" in line or "hashpartitioning(listing_id" in line for line in moved)
