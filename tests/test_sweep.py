"""Selectors in one sweep: against plain ancestor tests, on pages with many and deep matches, over many selectors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lotweave.operators.dom import with_dom
from lotweave.operators.selectors import compile_steps, terminal
from lotweave.operators.sweep import found_values, sweep
from tests import plain


def swept(dom, *rules):
    """One column f with the results of (selector, kind) rules."""
    steps = F.array(*[compile_steps(F.lit(r), F.lit(k)) for r, k in rules])
    return dom.withColumn("f", sweep(steps, F.array(*[terminal(F.lit(r), F.lit(k)) for r, k in rules])))


def random_page(rng, n):
    out, open_ = [], []
    for _ in range(n):
        if open_ and rng.random() < 0.4:
            out.append(f"</{open_.pop()}>")
        tag = rng.choice("abp")
        mark = rng.choice(["", " class='x'", " class='x y'", " id='k'", " href='u'"])
        out.append(f"<{tag}{mark}>{rng.choice(['', 't'])}")
        open_.append(tag)
    return "".join(out) + "".join(f"</{t}>" for t in reversed(open_))


SELECTORS = ["a", ".x", "#k", "a b", "a > b", ".x .y", "a .x > p", "p p p", "b > b > b", "[href] a", "a.x.y", "a #k b", "[document] > a", "q", "a q"]


def test_css_against_plain_ancestor_tests(spark, pages):
    rng = random.Random(2)
    htmls = [random_page(rng, rng.randint(0, 60)) for _ in range(60)] + [""]
    rows = swept(with_dom(pages(*htmls)), *[(s, "css") for s in SELECTORS]).select("page_id", "f").collect()
    for r in rows:
        tree = plain.Tree(htmls[r["page_id"]])
        for selector, hit in zip(SELECTORS, r["f"]):
            assert [s["id"] for s in hit["spans"]] == [n.id for n in plain.css(tree, selector)], (selector, htmls[r["page_id"]])


def test_xpath_strings(spark, pages):
    html = "<div>one<p>two<b>three</b></p></div><div>four<!--no--></div><p>five</p>"
    rules = [("//div/text()", "xpath"), ("//div//text()", "xpath"), ("/div/p//text()", "xpath"), ("//b", "xpath"), ("/b/text()", "xpath")]
    r = swept(with_dom(pages(html)), *rules).select(*[found_values(F.col("f")[i], terminal(F.lit(x), F.lit(k))).alias(f"v{i}") for i, (x, k) in enumerate(rules)]).first()
    assert list(r) == [["one", "four"], ["one", "two", "three", "four"], ["two", "three"], [""], []]


def test_selectors_outside_the_grammar_and_missing_ones(spark, pages):
    r = swept(with_dom(pages("<p>x</p>")), ("p +", "css"), ("p", "css")).select("f").first()["f"]
    assert r[0]["spans"] is None and len(r[1]["spans"]) == 1
    dom = with_dom(pages("<p>x</p>")).withColumn("s", F.lit(None).cast("array<array<string>>"))
    none = dom.select(sweep(F.lit(None), F.lit(None).cast("array<string>")).alias("f")).first()["f"]
    assert none is None


@pytest.mark.parametrize("shape", ["flat", "deep", "pairs"])
def test_fifty_thousand_elements_with_half_of_them_matching(spark, pages, shape):
    n = 25_000
    html = {
        "flat": "<ul>" + "<li>x<i></i></li>" * n + "</ul>",
        "deep": "<ul>" * n + "<li></li>" * n + "</ul>" * n,
        "pairs": "<ul><li>x</li></ul>" * n,
    }[shape]
    dom = with_dom(pages(html)).persist()
    size = dom.select(F.size("nodes")).first()[0]
    assert size >= 2 * n
    start = time.time()
    r = swept(dom, ("ul li", "css"), ("ul ul li", "css"), ("ul > li", "css"), ("//ul//text()", "xpath")).select(
        F.size("f"), *[F.size(F.col("f")[i]["spans"]).alias(f"n{i}") for i in range(4)], F.size(F.col("f")[3]["strings"]).alias("t")
    ).first()
    took = time.time() - start
    dom.unpersist()
    assert r["n0"] == n and r["n2"] == n and r["n1"] == (n if shape == "deep" else 0) and r["t"] == (0 if shape == "deep" else n)
    assert took < 30


def test_selectors_are_told_apart_without_reading_each():
    import pyarrow as pa

    from lotweave.operators import sweep as S

    attr = pa.struct([("name", pa.string()), ("op", pa.string()), ("value", pa.string())])
    step = pa.struct([("child", pa.bool_()), ("tag", pa.string()), ("id", pa.string()), ("classes", pa.list_(pa.string())), ("attrs", pa.list_(attr))])

    def one(tag=None, id=None, classes=(), attrs=(), child=False):
        return {"child": child, "tag": tag, "id": id, "classes": list(classes), "attrs": [dict(zip(("name", "op", "value"), a)) for a in attrs]}

    kinds = [
        None, [], [one("a")], [one(id="a")], [one("a", child=True)], [one("a"), one("b")], [one("b"), one("a")], [one("a", classes=["x"])],
        [one("a", classes=["x", "y"])], [one("a", classes=["y", "x"])], [one("a", classes=["x"]), one(classes=["y"])], [one("a"), one(classes=["x", "y"])],
        [one(attrs=[("x", "=", "y")])], [one(attrs=[("x", "=", None)])], [one(attrs=[("x", "=", "")])], [one(attrs=[("y", "=", "x")])], [one("")],
    ]
    asked = pa.array([kinds, None, kinds[::-1], []], pa.list_(pa.list_(step)))
    ends = pa.array([["element"] * len(kinds), None, ["element"] * 5 + ["text()"] + ["element"] * (len(kinds) - 6), []], pa.list_(pa.string()))
    for lists, said in ((asked, ends), (asked.slice(1), ends.slice(1))):
        selectors, numbers = S._selectors(lists, said)
        want = [(tuple(S._step(s) for s in x), e) if x else None for p, q in zip(lists.to_pylist(), said.to_pylist()) for x, e in zip(p or (), q or ())]
        assert [selectors[k] for k in numbers] == want
        # one number each: null, empty, and steps that differ in anything at all
        assert len(selectors) <= len(kinds) + 1

    class Counted(list):
        pass

    many = pa.array([[[one("a")], [one("b", classes=["x"])]]] * 5000, pa.list_(pa.list_(step)))
    read, real = Counted(), S._step
    S._step = lambda s: read.append(1) or real(s)
    try:
        assert len(S._selectors(many, pa.array([["element"] * 2] * 5000))[0]) == 2 and len(read) == 2
    finally:
        S._step = real
