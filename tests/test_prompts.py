"""Prompt texts, suggestion coverage and improvements of every page against plain Python."""

import json

from pyspark.sql import functions as F

from lotweave.constants import FIELD_DICTIONARY
from lotweave.operators.dom import with_dom
from lotweave.plans import generic, model
from lotweave.plans.compare import entries
from lotweave.plans.model import as_results
from lotweave.registry import QUERIES, corpus
from lotweave.registry.jobs import answers
from tests import plain
from tests.test_page_lines import brute

SF = "/root/testdata/sf0.001"


def test_prompts(spark):
    pages = {r["page_id"]: r for r in corpus.listing_pages(spark, SF).collect()}
    dom = with_dom(corpus.listing_pages(spark, SF)).select("page_id", F.to_json(generic.generic_fields()).alias("found"))
    found = {r["page_id"]: r["found"] for r in dom.collect()}
    got = {r["page_id"]: r["prompt"] for r in QUERIES["prompt_build"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    for i, text in got.items():
        task, rest = text.split("\n\nAddress: ")
        assert task == model._ASK and json.loads(found[i]) is not None
        assert rest == f"{pages[i]['url']}\n\nPage text:\n{brute(pages[i]['html'], 'model_input')}\n\nAlready found (check and extend):\n{found[i]}"
    listed = "\n".join(f"- {d[0]}: {d[1]}" for d in FIELD_DICTIONARY)
    whole = {r["page_id"]: r["prompt"] for r in QUERIES["selector_prompt"](spark, SF).collect()}
    assert whole == {i: f"Name a stable selector for each field:\n{listed}\n\nPage:\n{r['html']}" for i, r in pages.items()}


def test_coverage_and_improvements(spark):
    html = {r["page_id"]: r["html"] for r in corpus.listing_pages(spark, SF).collect()}
    given = {
        r["page_id"]: {a["field"]: a["value"] for a in r["given"] or []}
        for r in answers(spark, SF).select("page_id", F.when(F.col("success"), entries(as_results())).alias("given")).collect()
    }
    rows = {i: plain.suggestions(h, given.get(i)) for i, h in html.items()}
    got = {r["page_id"]: (r["coverage"], r["suggestions"]) for r in QUERIES["suggest_coverage"](spark, SF).collect()}
    assert got == {i: (len({r[0] for r in x}) / 13.0, len(x)) for i, x in rows.items()}
    compared = QUERIES["compare_fields"](spark, SF).collect()
    weak = {(r["page_id"], r["field"]): r["suggestion"] for r in compared if r["difference_type"] in ("missing", "different") and r["similarity"] < 0.7}
    want = sorted(
        (i, field, rank, weak[i, field] or "Field needs improvement", selector, confidence, value or "")
        for i, x in rows.items() for field, rank, selector, confidence, value, *_ in x if (i, field) in weak
    )
    found = QUERIES["improvements"](spark, SF).collect()
    assert sorted((r["page_id"], r["field"], r["rank"], r["current_issue"], r["suggested_selector"], r["confidence"], r["extracted_preview"] or "") for r in found) == want
    assert want and {r["selector_type"] for r in found} == {"css"}
