"""Queries over the element tree: raw web pages and listing pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.operators.dom import node_rows, text_rows, with_dom
from lotweave.operators.selectors import (
    Step, compile_steps, element_text, first, first_text, let, link_value, node_selector,
    page_lines, page_text, select, terminal, text_of,
)
from lotweave.operators.sweep import found_values, sweep
from lotweave.plans import mapping, site
from lotweave.registry import corpus as C
from lotweave.registry.base import query, truth

_COUNT = "cast((length(html) - length(replace(html, '<{0}', ''))) / {1} AS bigint) AS n_{2}"


@query("dom_nodes", "SELECT page_id, " + ", ".join(
    _COUNT.format(t + e, len(t + e) + 1, t) for t, e in (("li", ">"), ("a", " "), ("p", ">"), ("b", ">"), ("h1", ">"))) + " FROM pages")
def dom_nodes(spark, sf):
    nodes = node_rows(with_dom(C.driver_pages(spark, sf)))
    return nodes.groupBy("page_id").agg(
        *[F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("li", "a", "p", "b", "h1")])


@query("dom_texts", "SELECT page_id, cast(1 AS bigint) AS comments, cast(2 AS bigint) AS hidden, cast(1 AS bigint) AS doctypes FROM pages")
def dom_texts(spark, sf):
    texts = text_rows(with_dom(C.driver_pages(spark, sf)))
    return texts.groupBy("page_id").agg(
        F.count_if(F.col("kind") == "comment").alias("comments"), F.count_if(F.col("kind") == "hidden").alias("hidden"),
        F.count_if(F.col("kind") == "doctype").alias("doctypes"))


_CLEAN = r"regexp_replace(regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'gs'), '<[^>]*>', '', 'g')"
_DECODE = "{0}"
for _name, _char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    _DECODE = f"replace({_DECODE}, '&{_name};', '{_char}')"


@query("page_text", f"SELECT page_id, {_DECODE.format(_CLEAN)} AS text FROM pages")
def page_text_query(spark, sf):
    return with_dom(C.driver_pages(spark, sf)).select("page_id", page_text().alias("text"))


@query("page_lines", truth(f"SELECT listing_id AS page_id, {C.lines_sql('true', nav=True)} AS lines FROM listings"))
def page_lines_query(spark, sf):
    return with_dom(C.listing_pages(spark, sf)).select("page_id", page_lines().alias("lines"))


_H1 = _DECODE.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")
_AD = _DECODE.format("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")


@query("element_text", f"SELECT page_id, trim({_H1}) AS h1 FROM pages")
def element_text_query(spark, sf):
    return with_dom(C.driver_pages(spark, sf)).select("page_id", text_of([Step(tag="h1")]).alias("h1"))


@query("select_simple", f"SELECT page_id, trim({_AD}) AS ad FROM pages")
def select_simple(spark, sf):
    return with_dom(C.driver_pages(spark, sf)).select("page_id", text_of([Step(cls="ad")]).alias("ad"))


_LI = _COUNT.format("li>", 4, "items")
_FIRST = _DECODE.format("regexp_extract(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)")
_HREF = _DECODE.format("regexp_extract(html, '<li><a href=\"([^\"]*)\"', 1)")


@query("select_descendant", f"SELECT page_id, {_LI}, trim({_FIRST}) AS first_item FROM pages")
def select_descendant(spark, sf):
    found = select([Step(tag="nav"), Step(tag="li")])
    return with_dom(C.driver_pages(spark, sf)).select("page_id", found.alias("m"), "nodes", "texts").select(
        "page_id", F.size("m").cast("long").alias("n_items"), let(F.get("m", F.lit(0)), element_text).alias("first_item"))


@query("select_child", f"SELECT page_id, {_LI}, cast(0 AS bigint) AS n_direct FROM pages")
def select_child(spark, sf):
    direct = select([Step(tag="ul"), Step(tag="li", child=True)])
    none = select([Step(tag="nav"), Step(tag="li", child=True)])
    return with_dom(C.driver_pages(spark, sf)).select(
        "page_id", F.size(direct).cast("long").alias("n_items"), F.size(none).cast("long").alias("n_direct"))


def _with_rule(dom, rule: str, kind: str):
    r = F.lit(rule)
    return dom.withColumn("steps", compile_steps(r, F.lit(kind))).withColumn("end", terminal(r, F.lit(kind)))


@query("select_xpath", f"""SELECT page_id, {_H1} AS h1, {_HREF} AS first_href,
  cast((length(html) - length(replace(html, '<a ', ''))) / 3 AS int) AS n_links FROM pages""")
def select_xpath(spark, sf):
    dom = with_dom(C.driver_pages(spark, sf))
    rules = {"h1": "//article/h1/text()", "links": "//nav//a/@href"}
    steps, ends = (F.array(*[f(F.lit(r), F.lit("xpath")) for r in rules.values()]) for f in (compile_steps, terminal))
    swept = dom.withColumn("swept", sweep(steps, ends))
    cols = [found_values(F.get("swept", F.lit(i)), terminal(F.lit(r), F.lit("xpath"))).alias(n) for i, (n, r) in enumerate(rules.items())]
    return swept.select("page_id", *cols).select(
        "page_id", F.get("h1", F.lit(0)).alias("h1"), F.get("links", F.lit(0)).alias("first_href"), F.size("links").alias("n_links"))


@query("selector_test", f"""SELECT page_id, cast((length(html) - length(replace(html, '<li>', ''))) / 4 AS int) AS matches,
  true AS success, trim({_FIRST}) AS first_text FROM pages""")
def selector_test(spark, sf):
    dom = _with_rule(with_dom(C.driver_pages(spark, sf)), "[href]", "css")
    out = mapping.test_selector(dom, F.col("steps"), F.lit("css"), F.col("end"))
    return out.select("page_id", "matches", "success", F.get("texts", F.lit(0)).alias("first_text"))


@query("attr_projection", truth(f"""SELECT page_id, 'web' AS src, {_HREF} AS link FROM pages
  UNION ALL SELECT listing_id, 'listing', '/img/' || listing_id || '-1.jpg' FROM listings"""))
def attr_projection(spark, sf):
    link = let(first([Step(tag="nav"), Step(tag="a")]), link_value)
    image = let(first([Step(tag="img")]), link_value)
    return with_dom(C.driver_pages(spark, sf)).select("page_id", F.lit("web").alias("src"), link.alias("link")).unionByName(
        with_dom(C.listing_pages(spark, sf)).select("page_id", F.lit("listing").alias("src"), image.alias("link")))


@query("selector_gen", """SELECT page_id, '.ad' AS ad, 'html > body > article > h1' AS h1,
  'body > nav > ul > li' AS li, '[document] > html > head > title' AS title FROM pages""")
def selector_gen(spark, sf):
    at = lambda *steps: let(first(list(steps)), lambda n: node_selector(n.id))
    return with_dom(C.driver_pages(spark, sf)).select(
        "page_id", at(Step(cls="ad")).alias("ad"), at(Step(tag="h1")).alias("h1"), at(Step(tag="li")).alias("li"),
        at(Step(tag="title")).alias("title"))


@query("text_node_find", truth("""SELECT listing_id AS page_id, chr(10) || accident_text || chr(10) AS found,
  CASE WHEN accident_text IS NOT NULL THEN 'p' END AS tag FROM listings"""))
def text_node_find(spark, sf):
    hit = with_dom(C.listing_pages(spark, sf)).select("page_id", "nodes", "texts", first_text("(?i)accident").alias("t"))
    return hit.select("page_id", F.col("t.text").alias("found"), F.get("nodes", F.col("t.owner") - 1)["tag"].alias("tag"))


@query("accidents", truth("""SELECT listing_id AS page_id, CASE listing_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS accidents FROM listings"""))
def accidents(spark, sf):
    return with_dom(C.listing_pages(spark, sf)).select("page_id", site.accidents().alias("accidents"))
