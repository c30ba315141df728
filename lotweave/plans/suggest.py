"""Selector suggestions: where on a page the values of known fields seem to live.

Candidates come from text patterns, model answers and attribute keywords, and are ranked inside the
page row with array functions.  Trees, candidates and ranks never move: a model's answers meet the page
on ``page_id`` before its tree is built.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.constants import FIELD_DICTIONARY
from lotweave.operators.dom import with_dom
from lotweave.operators.lookup import keep_wanted, page_join
from lotweave.operators.selectors import compile_steps, element_text, let, literal, node_selector, only, strip
from lotweave.operators.sweep import sweep
from lotweave.plans.compare import entries
from lotweave.plans.model import as_results
from lotweave.sources.index import PageIndex
from lotweave.sources.pages import fetch_urls

TOP = 3  # selectors that a report shows per field

_ITEM = (
    "array<struct<strategy:int,seq:bigint,field:string,selector:string,confidence:double,"
    "value:string,reasoning:string>>"
)


def _item(strategy: int, seq: Column, field: Column, selector: Column, confidence: float, value: Column, why: Column) -> Column:
    return F.struct(
        F.lit(strategy).alias("strategy"), seq.cast("bigint").alias("seq"), field.alias("field"),
        selector.alias("selector"), F.lit(confidence).alias("confidence"), value.alias("value"),
        why.alias("reasoning"),
    )


def by_pattern(field: str, pattern: str) -> Column:
    """Strings of the page matching the field's pattern, pointing at their elements."""
    hits = F.filter(F.col("texts"), lambda t: t["text"].rlike(f"(?iU){pattern}"))
    return F.transform(
        hits,
        lambda t, i: _item(1, i, F.lit(field), node_selector(t["owner"]), 0.8, strip(t["text"]),
                           F.lit(f"Pattern match for {pattern}")),
    ).cast(_ITEM)


def located() -> Column:
    """Strings of the page that say something, with the elements that own them."""
    said = F.filter(F.col("texts"), lambda t: strip(t["text"]) != "")
    return F.transform(said, lambda t: F.struct(F.lower(t["text"]).alias("text"), t["owner"].alias("owner")))


def by_model(answers: Column, strings: Column, limit: int | None = None) -> Column:
    """Strings (``located``) holding each value a model gave (array of struct field, value); ``limit`` per value."""

    def locate(a: Column) -> Column:
        hits = let(F.lower(a["value"]), lambda v: F.filter(strings, lambda t: F.contains(t["text"], v)))
        return F.transform(
            hits if limit is None else F.slice(hits, 1, limit),
            lambda t, i: _item(2, i, a["field"], node_selector(t["owner"]), 0.9, a["value"],
                               F.concat(F.lit("AI identified this value: "), a["value"])),
        )

    return F.coalesce(F.flatten(F.transform(answers, locate)), F.array()).cast(_ITEM)


def trie_pattern(words: list[str]) -> str:
    """A pattern that matches, at a place, the longest of the words that stands there: common starts are read once."""
    tree: dict = {}
    for word in words:
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def written(at: dict) -> str:
        tails = [re.escape(c) + written(rest) for c, rest in sorted(at.items()) if c]
        if not tails:
            return ""
        return (tails[0] if len(tails) == 1 and "" not in at else f"(?:{'|'.join(tails)})") + ("?" if "" in at else "")

    return written(tree)


def by_keyword(fields: list[tuple[str, list[str]]], limit: int | None = None) -> Column:
    """Elements per keyword whose class, id or data attribute names it; ``limit`` per keyword and kind.

    Marks (lower-cased classes, id and data attributes) are taken once per element that has any, and one
    pattern over all keywords reads each mark once.  A data attribute counts for what follows ``data``.
    An element's selector and text are made once, and only where a mark names a keyword.
    """
    entries_ = [(w, field, at) for field, words in fields for at, w in enumerate(words)]
    every = sorted({w for w, _, _ in entries_})
    # at each place the longest keyword is read; keywords that it starts with stand there too
    pattern = literal(f"(?=({trie_pattern(every)}))")
    listed = ", ".join(f"named_struct('word', '{w}', 'field', '{f}', 'at', {at})" for w, f, at in entries_)
    named = ", ".join(f"'{w}', array({', '.join(str(k) for k, e in enumerate(entries_) if w.startswith(e[0]))})" for w in every)
    kinds = (("class name", 0.6, "cls"), ("ID", 0.7, "name"), ("data attribute", 0.8, "data"))
    marks = """filter(transform(nodes, n -> named_struct('id', n.id, 't0', n.t0, 't1', n.t1,
      'cls', lower(array_join(n.classes, ' ')), 'name', coalesce(lower(n.attrs['id']), ''),
      'data', array_join(transform(filter(transform(map_keys(n.attrs), k -> lower(k)), k -> contains(k, 'data')),
        k -> substr(k, locate('data', k) + 4)), ' '))),
      m -> m.cls <> '' OR m.name <> '' OR m.data <> '')"""
    # places in the dictionary, in its order, of the keywords that each kind of mark names
    read = ", ".join(
        f"'{col}', array_sort(array_distinct(flatten(transform(regexp_extract_all(m.{col}, {pattern}, 1), w -> map({named})[w]))))" for _, _, col in kinds
    )
    heard = F.expr(f"transform({marks}, (m, i) -> named_struct('id', m.id, 't0', m.t0, 't1', m.t1, 'place', i, {read}))")
    telling = F.filter(heard, lambda m: F.size(m["cls"]) + F.size(m["name"]) + F.size(m["data"]) > 0)
    shown = F.transform(telling, lambda m: F.struct(
        *[m[c].alias(c) for c in ("place", "cls", "name", "data")], node_selector(m["id"]).alias("selector"),
        F.concat(F.lit("#"), F.get("nodes", m["id"] - 1).attrs["id"]).alias("by_id"), only(element_text(m), lambda t: t != "").alias("value"),
    ))

    def items(m: Column, j: int) -> Column:
        kind, score, col = kinds[j]

        def item(k: Column) -> Column:
            d = F.get(F.expr(f"array({listed})"), k)
            seq = m["place"] + (d["at"] * 3 + j) * F.lit(4294967296)
            why = F.concat(F.lit("Keyword '"), d["word"], F.lit(f"' found in {kind}"))
            return _item(3, seq, d["field"], m["by_id" if kind == "ID" else "selector"], score, m["value"], why)

        return F.transform(m[col], item)

    hits = F.flatten(F.transform(shown, lambda m: F.concat(*[items(m, j) for j in range(len(kinds))])))
    if limit is not None:  # the first of each field, keyword and kind: places rise with the elements
        same = lambda g, h: (g["field"] == h["field"]) & (g["seq"] < h["seq"]) & (F.shiftright(g["seq"], 32) == F.shiftright(h["seq"], 32))
        hits = let(hits, lambda a: F.filter(a, lambda h: F.size(F.filter(a, lambda g: same(g, h))) < limit))
    return hits.cast(_ITEM)


def with_tested(dom: DataFrame, selectors: str) -> DataFrame:
    """Column ``tested``: what each of the page's selectors finds on it, a map of selector to (matches, text).

    All selectors of a page are found in one sweep; text is that of the first match.  A selector that no
    grammar fits has null matches.
    """
    steps = F.transform(selectors, lambda s: compile_steps(s, F.lit("css")))

    def result(hit: Column) -> Column:
        first = F.get(F.col("nodes"), F.get(hit["spans"], F.lit(0)).id - 1)
        return F.struct(F.when(hit["spans"].isNotNull(), F.size(hit["spans"])).alias("matches"), element_text(first).alias("text"))

    # a generated column: the planner leaves nested lambdas inside a Python function's argument unevaluated
    ready = dom.select("*", F.explode(F.array(steps)).alias("steps"))
    swept = ready.withColumn("swept", sweep(F.col("steps"), F.transform(selectors, lambda s: F.lit("element"))))
    return swept.withColumn("tested", F.map_from_arrays(selectors, F.transform("swept", result))).drop("swept", "steps")


def with_answers(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages with ``given``: the (field, value) entries of their model answers, null where there is none.

    To be joined before ``with_dom``: a body is smaller than its tree and candidates, and pages dealt or
    bucketed by ``page_id`` do not move at all.
    """
    given = answers.select("page_id", F.when(F.col("success"), entries(as_results())).alias("given"))
    return page_join(pages, given)


def candidates(dom: DataFrame, fields: list[str] | None = None, answers: DataFrame | None = None, check: bool = False) -> DataFrame:
    """All candidates of each page: (page_id, found array), with ``check`` a map of what their selectors find.

    Model answers come with the page (``with_answers``), or as ``answers`` (parsed ones), which moves the
    pages' trees.  Everything else stays in the page row.  A column ``weak`` passes through.
    """
    if answers is not None:
        dom = with_answers(dom, answers)
    wanted = [d for d in FIELD_DICTIONARY if fields is None or d[0] in fields]
    parts = [by_pattern(name, p) for name, _, _, p, _ in wanted if p]
    parts.append(by_keyword([(name, words) for name, _, _, _, words in wanted]))
    if "given" in dom.columns:
        asked = F.filter("given", lambda a: a["field"].isin([d[0] for d in wanted]))
        parts.append(let(located(), lambda strings: by_model(asked, strings)))
    keep = ["page_id", *[c for c in ("weak",) if c in dom.columns]]
    # a generated column: its parts are made once, whatever is asked of them
    slim = dom.select(*keep, "nodes", "texts", F.explode(F.array(F.concat(*parts))).alias("found"))
    if check:
        selectors = F.array_distinct(F.array_compact(F.col("found.selector")))
        slim = with_tested(slim.withColumn("selectors", selectors), "selectors").drop("selectors")
    return slim.drop("nodes", "texts")


def candidate_rows(found: DataFrame) -> DataFrame:
    """One row per candidate (page_id, strategy, seq, field, selector, ...)."""
    return found.select("page_id", F.inline_outer("found")).where("field IS NOT NULL")


def rank(found: DataFrame, top: int | None = None) -> DataFrame:
    """Selectors per page, best first within each field: (page_id, ranked array), the best ``top`` or all.

    Duplicates keep their first mention, ties their order.  All in the page row: no shuffle.
    """
    lean = "x.confidence, x.value, x.reasoning"
    ordered = F.expr("array_sort(transform(filter(found, x -> x.selector IS NOT NULL), x -> struct(x.field, x.selector, x.strategy, x.seq, "
                     + lean + ")))")
    once = F.expr("filter(ordered, (x, i) -> i = 0 OR ordered[i - 1].field != x.field OR ordered[i - 1].selector != x.selector)")
    best = F.expr(f"array_sort(transform(once, x -> struct(x.field, -x.confidence AS lack, x.strategy, x.seq, x.selector, {lean})))")
    placed = F.expr(f"""transform(best, (x, i) -> struct(x.field, x.selector, {lean},
      cast(i + 2 - array_position(fields, x.field) AS int) AS rank))""")
    kept = F.filter("placed", lambda x: F.lit(True) if top is None else x["rank"] <= top)
    key = [c for c in found.columns if c != "found"]
    ranked = (
        found.select(*key, ordered.alias("ordered"))
        .select(*key, once.alias("once"))
        .select(*key, best.alias("best"))
        .select(*key, "best", F.col("best.field").alias("fields"))
        .select(*key, placed.alias("placed"))
        .select(*key, kept.alias("ranked"))
    )
    if "tested" not in key:
        return ranked
    # a selector's own test beside it
    seen = F.transform("ranked", lambda x: F.struct(
        *[x[c].alias(c) for c in ("field", "selector", "confidence", "value", "reasoning", "rank")],
        (F.coalesce(F.element_at("tested", x["selector"])["matches"], F.lit(0)) > 0).alias("hit"),
        F.element_at("tested", x["selector"])["matches"].alias("matches"),
        F.element_at("tested", x["selector"])["text"].alias("extracted"),
    ))
    return ranked.withColumn("ranked", seen).drop("tested")


def ranked_rows(ranked: DataFrame) -> DataFrame:
    """One row per page, field and selector, with its rank and whether a report of the best few shows it."""
    # outer: else a test for empty arrays is pushed down, with the whole ranking copied into it
    rows = ranked.select("page_id", F.inline_outer("ranked")).where("field IS NOT NULL")
    return rows.withColumn("within_limit", F.col("rank") <= TOP)


def suggest_coverage(ranked: DataFrame, n_fields: int = len(FIELD_DICTIONARY)) -> DataFrame:
    """Share of the fields with a suggestion, for every page."""
    fields = F.size(F.array_distinct(F.col("ranked.field")))
    return ranked.select("page_id", (fields / float(n_fields)).alias("coverage"), F.size("ranked").cast("long").alias("suggestions"))


def for_urls(urls: DataFrame, pages: DataFrame, source: PageIndex | DataFrame, answers: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Suggestions per distinct requested URL: (url, page_id, success, ranked, coverage, error).

    URLs are looked up in ``source`` (the pages' index, or the pages); only bodies of pages that are
    found are read.  A URL without a page fails with the reason and has no suggestions.
    """
    found = fetch_urls(urls, source).select("url", "page_id", F.col("error").alias("fetch_error"))
    wanted = keep_wanted(pages, found, "page_id")
    dom = with_dom(wanted if answers is None else with_answers(wanted, answers))
    ranked = rank(candidates(dom, fields, check=True))
    share = suggest_coverage(ranked, len(FIELD_DICTIONARY if fields is None else fields)).select("page_id", "coverage")
    rows = found.join(ranked, "page_id", "left").join(share, "page_id", "left")
    return rows.select(
        "url", "page_id", F.col("fetch_error").isNull().alias("success"),
        F.coalesce("ranked", F.array().cast(ranked.schema["ranked"].dataType)).alias("ranked"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.concat(F.lit("Failed to fetch URL: "), F.col("fetch_error")).alias("error"),
    )


def with_weak(pages: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Pages that have fields which are missing or clearly different, with ``weak``: these (field, suggestion).

    To be joined before ``with_dom``, as answers are: candidates and ranks then stay in their page row.
    """
    weak = comparisons.where(F.col("difference_type").isin("missing", "different") & (F.col("similarity") < 0.7))
    return page_join(pages, weak.groupBy("page_id").agg(F.collect_list(F.struct("field", "suggestion")).alias("weak")), "inner")


def improvements(ranked: DataFrame) -> DataFrame:
    """Suggestions for the ``weak`` fields of ranked pages, with what is wrong now."""

    def better(w: Column) -> Column:
        return F.transform(
            F.filter("ranked", lambda x: x["field"] == w["field"]),
            lambda x: F.struct(
                x["field"].alias("field"), x["rank"].alias("rank"),
                F.coalesce(w["suggestion"], F.lit("Field needs improvement")).alias("current_issue"),
                x["selector"].alias("suggested_selector"), F.lit("css").alias("selector_type"),
                x["confidence"].alias("confidence"), x["reasoning"].alias("reasoning"), x["value"].alias("extracted_preview"),
            ),
        )

    return ranked.select("page_id", F.inline_outer(F.flatten(F.transform("weak", better)))).where("field IS NOT NULL")


def field_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        FIELD_DICTIONARY, "field string, description string, type string, pattern string, keywords array<string>"
    )
