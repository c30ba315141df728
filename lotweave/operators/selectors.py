"""Selectors as Column expressions over the ``nodes`` / ``texts`` arrays of a page row.

Two ways in, one meaning: ``Step`` objects for selectors fixed in code, folded over candidate
intervals, and ``compile_steps`` for selectors that arrive as data (any number of sites), which
``sweep`` evaluates.  Cost is per page and no rows are produced before a value is known.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.constants import WHITESPACE

STEP_TYPE = (
    "array<struct<child:boolean,tag:string,id:string,classes:array<string>,"
    "attrs:array<struct<name:string,op:string,value:string>>>>"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once; inside a lambda a plain column reference would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def only(value: Column, test: Callable[[Column], Column]) -> Column:
    """The value where it passes the test, else null; computed once."""
    return let(value, lambda v: F.when(test(v), v))


def blank_to_null(text: Column) -> Column:
    return only(text, lambda t: t != "")


# --- fixed selectors ---------------------------------------------------------------------------

def literal(text: str) -> str:
    """A string as a SQL literal; patterns keep their backslashes."""
    return "r'" + text.replace("'", "\\'") + "'" if "'" not in text else '"' + text + '"'


@dataclass(frozen=True)
class Step:
    """One compound of a selector; ``child`` means the direct-child combinator.

    Fixed selectors are written out as SQL lambdas: one expression string per selector instead of
    hundreds of small Column calls when a plan is built.
    """

    tag: str | None = None
    cls: str | None = None
    attr: tuple[str, str, str] | None = None  # name, op ('=', '*=', '^='), value
    child: bool = False

    def sql(self, n: str) -> str:
        tests = []
        if self.tag:
            tests.append(f"{n}.tag = {literal(self.tag)}")
        if self.cls:
            tests.append(f"array_contains({n}.classes, {literal(self.cls)})")
        if self.attr:
            name, op, value = self.attr
            got = f"array_join({n}.classes, ' ')" if name == "class" else f"{n}.attrs[{literal(name)}]"
            call = {"=": "{0} = {1}", "*=": "contains({0}, {1})", "^=": "startswith({0}, {1})"}[op]
            tests.append(f"coalesce({call.format(got, literal(value))}, false)")
        return " AND ".join(tests) or "true"


def select_sql(steps: list[Step]) -> str:
    found = f"filter(nodes, n0 -> {steps[0].sql('n0')})"
    for i, step in enumerate(steps[1:], 1):
        placed = f"s.id = n{i}.parent" if step.child else f"s.id < n{i}.id AND n{i}.id <= s.last"
        keep = f"n{i} -> {step.sql(f'n{i}')} AND exists(c{i}, s -> {placed})"
        found = f"get(transform(array({found}), c{i} -> filter(nodes, {keep})), 0)"
    return found


def element_sql(e: str) -> str:
    """Text of an element, each piece stripped and joined without a separator."""
    mine = f"slice(texts, {e}.t0 + 1, {e}.t1 - {e}.t0)"
    shown = f"filter({mine}, t -> t.kind = 'text' OR (t.kind = 'hidden' AND t.owner = {e}.id))"
    return f"array_join(transform({shown}, t -> btrim(t.text, '{WHITESPACE}')), '')"


def select(steps: list[Step]) -> Column:
    """All nodes matching the steps, in document order."""
    return F.expr(select_sql(steps))


def first(steps: list[Step]) -> Column:
    return F.expr(f"get({select_sql(steps)}, 0)")


def text_of(*choices: list[Step]) -> Column:
    """Text of the first element that exists among the choices, null when none does."""
    found = ", ".join(f"get({select_sql(c)}, 0)" for c in choices)
    return F.expr(f"get(transform(array(coalesce({found})), e -> {element_sql('e')}), 0)")


def texts_of(cascade: list[list[Step]]) -> Column:
    """Texts of the elements found by the first selector that finds any."""
    return F.expr(f"transform({cascade_sql(cascade)}, e -> {element_sql('e')})")


def cascade_sql(cascade: list[list[Step]]) -> str:
    tries = [f"get(transform(array({select_sql(s)}), m -> if(size(m) > 0, m, null)), 0)" for s in cascade]
    return f"coalesce({', '.join(tries)})"


# --- text of elements --------------------------------------------------------------------------


def _pieces(n: Column) -> Column:
    mine = F.slice(F.col("texts"), n.t0 + 1, n.t1 - n.t0)
    return F.filter(mine, lambda t: (t.kind == "text") | ((t.kind == "hidden") & (t.owner == n.id)))


def raw_text(n: Column) -> Column:
    """Text of an element, pieces joined as they are."""
    return F.array_join(F.transform(_pieces(n), lambda t: t.text), "")


def element_text(n: Column) -> Column:
    """Text of an element, each piece stripped and joined without a separator."""
    return F.array_join(F.transform(_pieces(n), lambda t: strip(t.text)), "")


def page_text() -> Column:
    """Visible text of the page, pieces joined as they are (scripts, styles, comments dropped)."""
    return F.expr("array_join(transform(filter(texts, t -> t.kind = 'text'), t -> t.text), '')")


def page_lines() -> Column:
    """Visible text, one stripped piece per line, empty pieces dropped."""
    pieces = f"transform(filter(texts, t -> t.kind = 'text'), t -> btrim(t.text, '{WHITESPACE}'))"
    return F.expr(f"array_join(filter({pieces}, p -> p <> ''), '\\n')")


def first_text(pattern: str) -> Column:
    """First string of the page (of any kind) matching a regex: struct owner, kind, text."""
    return F.expr(f"get(filter(texts, t -> t.text RLIKE {literal(pattern)}), 0)")


def owner_node(text: Column) -> Column:
    """Element holding a string; the document itself for strings outside any element."""
    root = F.struct(
        F.lit(0).alias("id"), F.lit(0).alias("t0"), F.size("texts").cast("int").alias("t1")
    )
    at = F.get(F.col("nodes"), text.owner - 1)
    return F.when(text.owner == 0, root).when(
        text.owner > 0, F.struct(at.id.alias("id"), at.t0.alias("t0"), at.t1.alias("t1"))
    )


def link_value(n: Column) -> Column:
    """Value an element stands for: image source, link target, input value, else its text."""
    src = n.attrs["src"]
    return (
        F.when(n.tag == "img", F.when(src != "", src).otherwise(n.attrs["data-src"]))
        .when(n.tag == "a", n.attrs["href"])
        .when(n.attrs["value"] != "", n.attrs["value"])
        .otherwise(element_text(n))
    )


def node_selector(node_id: Column) -> Column:
    """Selector that points at a node: #id, else .class.class, else a path of at most 4 steps."""

    def climb(acc: Column, _: Column) -> Column:
        n = F.get(F.col("nodes"), acc.id - 1)
        name = F.when(acc.id == 0, F.lit("[document]")).otherwise(
            F.concat_ws(".", F.concat(F.array(n.tag), n.classes))
        )
        return F.when(acc.id < 0, acc).otherwise(
            F.struct(
                F.when(acc.id == 0, F.lit(-1)).otherwise(n.parent).alias("id"),
                F.concat(F.array(name), acc.parts).alias("parts"),
            )
        )

    start = F.struct(node_id.cast("int").alias("id"), F.array().cast("array<string>").alias("parts"))
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(4)), start, climb, lambda acc: F.array_join(acc.parts, " > ")
    )
    n = F.get(F.col("nodes"), node_id - 1)
    return (
        F.when(n.attrs["id"] != "", F.concat(F.lit("#"), n.attrs["id"]))
        .when(F.size(n.classes) > 0, F.concat(F.lit("."), F.array_join(n.classes, ".")))
        .otherwise(path)
    )


# --- selectors that arrive as data --------------------------------------------------------------

_NAME = r"[\w-]+"
_CSS_TEST = rf"(?:[.#]{_NAME}|\[\s*{_NAME}\s*(?:[*^$~]?=\s*(?:\"[^\"]*\"|'[^']*'|{_NAME})\s*)?\])"
_CSS_COMPOUND = rf"(?:(?:\*|{_NAME}){_CSS_TEST}*|{_CSS_TEST}+)"
_CSS_OK = rf"^\s*{_CSS_COMPOUND}(?:(?:\s*>\s*|\s+){_CSS_COMPOUND})*\s*$"
_XPATH_TEST = rf"(?:contains\(\s*@{_NAME}\s*,\s*(?:'[^']*'|\"[^\"]*\")\s*\)|@{_NAME}(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"))?)"
_XPATH_STEP = rf"/{{1,2}}(?:\*|{_NAME})(?:\[\s*{_XPATH_TEST}(?:\s+and\s+{_XPATH_TEST})*\s*\])*"
_XPATH_OK = rf"^(?:{_XPATH_STEP})+(?:/{{1,2}}text\(\)|/@{_NAME})?$"


def _attr_tests(found: Column, pattern: str, op: Column | None) -> Column:
    return F.transform(
        found,
        lambda a: F.struct(
            F.regexp_extract(a, pattern, 1).alias("name"),
            (op if op is not None else F.coalesce(
                blank_to_null(F.regexp_extract(a, pattern, 2)), F.lit("exists"))).alias("op"),
            F.regexp_replace(F.regexp_extract(a, pattern, 3), "^[\"']|[\"']$", "").alias("value"),
        ),
    )


def _css_steps(rule: Column) -> Column:
    tokens = F.regexp_extract_all(rule, F.lit(r">|(?:[^\s>\[\]]|\[[^\]]*\])+"), F.lit(0))

    def step(t: Column, i: Column) -> Column:
        bare = F.regexp_replace(t, r"\[[^\]]*\]", "")
        attrs = F.regexp_extract_all(t, F.lit(r"\[[^\]]*\]"), F.lit(0))
        return F.struct(
            ((i > 0) & F.coalesce(F.get(tokens, i - 1) == ">", F.lit(False))).alias("child"),
            F.lower(blank_to_null(F.regexp_extract(bare, rf"^({_NAME})", 1))).alias("tag"),
            blank_to_null(F.regexp_extract(bare, rf"#({_NAME})", 1)).alias("id"),
            F.regexp_extract_all(bare, F.lit(rf"\.({_NAME})"), F.lit(1)).alias("classes"),
            _attr_tests(attrs, rf"\[\s*({_NAME})\s*([*^$~]?=)?\s*(.*?)\s*\]", None).alias("attrs"),
            (t == ">").alias("mark"),
        )

    steps = F.filter(F.transform(tokens, step), lambda s: ~s.mark)
    return F.transform(steps, lambda s: F.struct(s.child.alias("child"), s.tag.alias("tag"),
                                                 s.id.alias("id"), s.classes.alias("classes"),
                                                 s.attrs.alias("attrs")))


def _xpath_steps(rule: Column) -> Column:
    body = F.regexp_replace(rule, rf"(?:/{{1,2}}text\(\)|/@{_NAME})$", "")
    tokens = F.regexp_extract_all(body, F.lit(r"/{1,2}(?:[^/\[]|\[[^\]]*\])+"), F.lit(0))

    def step(t: Column) -> Column:
        tests = F.array_join(F.regexp_extract_all(t, F.lit(r"\[([^\]]*)\]"), F.lit(1)), " and ")
        has = F.regexp_extract_all(tests, F.lit(rf"contains\(\s*@{_NAME}\s*,\s*(?:'[^']*'|\"[^\"]*\")"), F.lit(0))
        rest = F.regexp_replace(tests, r"contains\([^)]*\)", "")
        plain = F.regexp_extract_all(rest, F.lit(rf"@{_NAME}(?:\s*=\s*(?:'[^']*'|\"[^\"]*\"))?"), F.lit(0))
        return F.struct(
            (~F.startswith(t, F.lit("//"))).alias("child"),
            F.lower(blank_to_null(F.regexp_extract(t, rf"^/+({_NAME})", 1))).alias("tag"),
            F.lit(None).cast("string").alias("id"),
            F.array().cast("array<string>").alias("classes"),
            F.concat(
                _attr_tests(has, rf"@({_NAME})(\s*),\s*(.*)$", F.lit("*=")),
                _attr_tests(plain, rf"@({_NAME})\s*(=)?\s*(.*)$", None),
            ).alias("attrs"),
        )

    return F.transform(tokens, step)


def rule_kind(rule: Column, kind: Column | None = None) -> Column:
    """static / css / xpath of a rule string (a bare tag name is a static value)."""
    found = (
        F.when(rule.isNull() | (rule == ""), F.lit("static"))
        .when(F.startswith(rule, F.lit("/")), F.lit("xpath"))
        .when(rule.rlike(r"^[.#\[]"), F.lit("css"))
        .otherwise(F.lit("static"))
    )
    return found if kind is None else F.coalesce(kind, found)


def selector_ok(rule: Column, kind: Column) -> Column:
    """Is the selector inside the supported grammar?"""
    return F.when(kind == "xpath", rule.rlike(_XPATH_OK)).when(
        kind == "css", (F.trim(rule) != "") & rule.rlike(_CSS_OK)
    )


def compile_steps(rule: Column, kind: Column) -> Column:
    """Steps of a selector, null when the selector is outside the grammar or there is none."""
    return F.when(
        selector_ok(rule, kind),
        F.when(kind == "xpath", _xpath_steps(rule)).otherwise(_css_steps(rule)),
    ).cast(STEP_TYPE)


def terminal(rule: Column, kind: Column) -> Column:
    """What an XPath ends in: 'element', 'text()', '//text()' or '@name'."""
    return (
        F.when(kind != "xpath", F.lit("element"))
        .when(rule.rlike(r"//text\(\)$"), F.lit("//text()"))
        .when(rule.rlike(r"/text\(\)$"), F.lit("text()"))
        .when(rule.rlike(rf"/@{_NAME}$"), F.regexp_extract(rule, rf"(@{_NAME})$", 1))
        .otherwise(F.lit("element"))
    )
