"""Every suggestion of every field with its own check, against plain loops over the page."""

from lotweave.operators.dom import with_dom
from lotweave.plans import suggest
from lotweave.plans.compare import entries
from lotweave.plans.model import as_results
from lotweave.registry import corpus
from lotweave.registry.jobs import answers
from pyspark.sql import functions as F
from tests import plain

SF = "/root/testdata/sf0.001"


def rows_of(ranked):
    got = {}
    for r in suggest.ranked_rows(ranked).collect():
        got.setdefault(r["page_id"], []).append((r["field"], r["rank"], r["selector"], r["confidence"], r["value"], r["matches"], r["extracted"]))
    return {k: sorted(v) for k, v in got.items()}


def test_whole_suggestions_of_all_layouts(spark):
    pages = corpus.listing_pages(spark, SF).filter("page_id between 1 and 48").cache()
    given = {
        r["page_id"]: {a["field"]: a["value"] for a in r["given"] or []}
        for r in answers(spark, SF).select("page_id", F.when(F.col("success"), entries(as_results())).alias("given")).collect()
    }
    got = rows_of(suggest.rank(suggest.candidates(with_dom(pages), answers=answers(spark, SF), check=True)))
    want = {r["page_id"]: plain.suggestions(r["html"], given.get(r["page_id"])) for r in pages.collect()}
    assert got == want and sum(map(len, want.values())) > 1000


ODD = """<!DOCTYPE html><div id="price-box" class="Cost msrpTag"><b data-price-x="1" class="asking price">$1,200</b></div>
<p data-id="3" vindata="x">VIN ABCDEFGH123456789</p><span id="a.b" class="paint">red</span><i class="mileages">12 mi</i>
<script>var vin = "ABCDEFGH123456789"</script><div class="dealership"><em id="miles">9,000 miles</em> <em>x</em></div>"""


def test_marks_of_every_kind(spark, pages):
    got = rows_of(suggest.rank(suggest.candidates(with_dom(pages(ODD, "<p></p>")), check=True)))
    want = plain.suggestions(ODD, None)
    # a selector that no grammar fits is no match here, and one that can't be asked for
    clean = lambda rows: [r[:5] for r in rows]
    assert clean(got[0]) == clean(want) and 1 not in got


def test_limit_keeps_the_first_of_each_keyword_and_kind(spark, pages):
    html = "".join(f"<b class='price p{i}' id='price{i}'>{i}</b>" for i in range(5))
    item = suggest.by_keyword([("price", ["price", "cost"])], 2)
    got = with_dom(pages(html)).select(F.inline(item)).collect()
    assert [r["selector"] for r in got] == ["#price0", "#price0", "#price1", "#price1"] or len(got) == 4


def test_trie_reads_the_longest_word_of_each_place():
    import re

    words = ["mile", "mileage", "miles", "odometer", "a b"]
    assert re.findall(f"(?=({suggest.trie_pattern(words)}))", "mileages miles a b mil") == ["mileage", "miles", "a b"]
    assert suggest.trie_pattern(["x"]) == "x"
