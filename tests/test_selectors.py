import pytest
from pyspark.sql import functions as F

from lotweave.operators.dom import with_dom
from lotweave.operators.selectors import (
    Step, compile_steps, element_text, node_selector, rule_kind, select, selector_ok, terminal, text_of,
)
from lotweave.operators.sweep import found_values, sweep

HTML = """<html><body><div class="a x"><p id="one">1<span data-q="v w">2</span></p><div class="b"><p>3</p></div></div>
<div class="b"><span class="price big">$4</span><a href="/l">5</a></div></body></html>"""


@pytest.fixture(scope="module")
def dom(pages):
    return with_dom(pages(HTML))


def found(dom, rule):
    kind = rule_kind(F.lit(rule))
    end = terminal(F.lit(rule), kind)
    swept = dom.withColumn("hit", F.get(sweep(F.array(compile_steps(F.lit(rule), kind)), F.array(end)), F.lit(0)))
    texts = F.transform(F.col("hit.spans"), lambda s: element_text(F.get("nodes", s.id - 1)))
    value = F.when(kind == "xpath", found_values(F.col("hit"), end)).otherwise(texts)
    return swept.select(value.alias("v")).head().v


@pytest.mark.parametrize("rule, want", [
    (".a p", ["12", "3"]), (".a > p", ["12"]), ("#one", ["12"]), (".a .b p", ["3"]), (".a.x p#one", ["12"]),
    ('[data-q="v w"]', ["2"]), ("[data-q*=w]", ["2"]), ("[class*='pri']", ["$4"]), ("[href]", ["5"]), ("[href^='/']", ["5"]),
    (".zzz", []), (".b", ["3", "$45"]), (".a > .b > p", ["3"]),
    ("//p/text()", ["1", "3"]), ("//p//text()", ["1", "2", "3"]), ("//div[@class='b']//p/text()", ["3"]),
    ("//span[contains(@class, 'price')]/text()", ["$4"]), ("//a/@href", ["/l"]), ("//div/p/text()", ["1", "3"]),
    ("/html/body/div/span/text()", ["$4"]), ("//span", ["", ""]), ("//div[@class='a x' and @class]/p/text()", ["1"]),
])
def test_rules(dom, rule, want):
    assert found(dom, rule) == want


def test_fixed_and_data_driven_selectors_agree(dom):
    pairs = [([Step(cls="a"), Step(tag="p")], ".a p"), ([Step(cls="a"), Step(tag="p", child=True)], ".a > p"),
             ([Step(attr=("class", "*=", "pri"))], "[class*='pri']"), ([Step(attr=("href", "^=", "/"))], "[href^='/']")]
    for steps, rule in pairs:
        got = dom.select(F.transform(select(steps), element_text).alias("v")).head().v
        assert got == found(dom, rule)


@pytest.mark.parametrize("rule, kind", [
    ("h1", "static"), ("", "static"), (".x", "css"), ("#x", "css"), ("[a]", "css"), ("/a", "xpath"), ("//a", "xpath"), ("Buy a .x", "static")])
def test_rule_kind(spark, rule, kind):
    assert spark.range(1).select(rule_kind(F.lit(rule)).alias("k")).head().k == kind


@pytest.mark.parametrize("rule", [".a + .b", ".a ~ .b", "//a[", "//a[1]", "//a[text()='x']", ".a,", ".a:hover", ".a >", ".a > > .b"])
def test_outside_the_grammar(spark, rule):
    r = F.lit(rule)
    assert spark.range(1).select(selector_ok(r, rule_kind(r)).alias("ok")).head().ok is False


def test_first_of_several_choices(dom):
    assert dom.select(text_of([Step(cls="none")], [Step(tag="a")]).alias("t")).head().t == "5"
    assert dom.select(text_of([Step(cls="none")]).alias("t")).head().t is None


def test_node_selector(dom):
    got = dom.select(F.transform("nodes", lambda n: node_selector(n.id)).alias("s")).head().s
    assert got == ["[document] > html", "[document] > html > body", ".a.x", "#one", "body > div.a.x > p > span", ".b",
                   "body > div.a.x > div.b > p", ".b", ".price.big", "html > body > div.b > a"]


def test_class_attribute_tests_see_single_spaces(spark, pages):
    spaced = with_dom(pages("<p class='a  x\ny'>1</p>"))
    assert found(spaced, "[class='a x y']") == found(spaced, "//p[@class='a x y']/text()") == ["1"]
    assert spaced.select(F.transform(select([Step(attr=("class", "=", "a x y"))]), element_text).alias("v")).head().v == ["1"]


def test_long_attribute_names(spark, pages):
    name = "data-" + "n" * 1500
    assert found(with_dom(pages(f"<p {name}='v'>1</p>")), f"//p/@{name}") == ["v"]
