"""Mapping results against model answers, field by field and page by page.

One join on ``page_id`` of slim rows; the fields of a page are then exploded in place, so the
per-page scores combine before their shuffle and send one row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.constants import CRITICAL_FIELDS, EXPECTED_FIELDS, FIELD_ORDER, SIMILARITY_WEIGHTS
from lotweave.functions.similarity import text_ratio
from lotweave.operators.lookup import page_join
from lotweave.operators.selectors import let, strip
from lotweave.plans.model import as_results


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 for equal text, a relative difference for two numbers, null when neither applies.

    A dollar sign makes text numeric but unreadable as a number, so such pairs compare as text.
    """
    bare_a, bare_b = (F.replace(x, F.lit(","), F.lit("")) for x in (a, b))

    def diff(x: Column, y: Column) -> Column:
        return (
            F.when(x == y, 1.0)
            .when((x == 0) | (y == 0), 0.0)
            .otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(x - y) / F.greatest(x, y)))
        )

    both = bare_a.rlike(_NUMBER) & bare_b.rlike(_NUMBER)
    return F.when(a == b, 1.0).when(
        both, let(bare_a.try_cast("double"), lambda x: let(bare_b.try_cast("double"), lambda y: diff(x, y)))
    )


def with_similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``similarity``; only pairs that are neither equal nor numbers reach Python."""
    a, b = F.lower(strip(F.col(left))), F.lower(strip(F.col(right)))
    quick = pairs.withColumn("_quick", numeric_similarity(a, b))
    rest = F.col("_quick").isNull() & F.col(left).isNotNull() & F.col(right).isNotNull()
    slow = text_ratio(F.when(rest, a), F.when(rest, b))
    return quick.withColumn("_slow", slow).withColumn("similarity", F.coalesce("_quick", "_slow")).drop("_quick", "_slow")


def _shown(f: Column) -> Column:
    """A value as text; lists in brackets with quoted items."""
    quoted = F.transform(
        f["values"],
        lambda v: F.when(F.contains(v, F.lit("'")) & ~F.contains(v, F.lit('"')), F.concat(F.lit('"'), v, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("\\'")), F.lit("'"))),
    )
    return F.when(f["is_list"], F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))).otherwise(f["value"])


def entries(fields: Column) -> Column:
    """Top-level fields with a value; dotted fields appear under their head."""
    hits = F.filter(fields, lambda f: f["success"])
    flat = F.transform(
        F.filter(hits, lambda f: ~F.contains(f["field"], F.lit("."))),
        lambda f: F.struct(f["field"].alias("field"), _shown(f).alias("value"), f["is_list"].alias("is_list")),
    )
    heads = F.array_distinct(
        F.transform(
            F.filter(hits, lambda f: F.contains(f["field"], F.lit("."))),
            lambda f: F.substring_index(f["field"], ".", 1),
        )
    )

    def nested(head: Column) -> Column:
        inner = F.filter(hits, lambda f: F.startswith(f["field"], F.concat(head, F.lit("."))))
        items = F.transform(
            inner,
            lambda f: F.concat(F.lit("'"), F.regexp_replace(f["field"], r"^[^.]*\.", ""), F.lit("': '"), f["value"], F.lit("'")),
        )
        return F.struct(
            head.alias("field"), F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}")).alias("value"),
            F.lit(False).alias("is_list"),
        )

    return F.concat(flat, F.transform(heads, nested))


def coverage(found: Column) -> Column:
    """Share of the expected fields with a meaningful value."""
    useful = F.filter(
        found,
        lambda e: F.array_contains(F.lit(EXPECTED_FIELDS), e["field"]) & (strip(e["value"]) != "")
        & (e["value"] != "0") & (e["value"] != "[]"),
    )
    return F.size(useful) / float(len(EXPECTED_FIELDS))


def pair_up(previews: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per previewed page with both sides' entries; ``model`` is null where the answer failed or is missing.

    Pages of sites without rules have no mapping side, but the preview's error.
    """
    known = F.col("fields").isNotNull()
    left = previews.select(
        "page_id", F.when(known, entries(F.col("fields"))).alias("mapping"), F.when(~known, F.array_join("errors", ", ")).alias("mapping_error"),
        F.transform("fields", lambda f: F.struct(f["field"].alias("field"), f["success"].alias("success"))).alias("tried"),
        F.col("confidence").alias("mapping_confidence"), F.size("errors").alias("mapping_errors"),
    )
    right = answers.select("page_id", F.when(F.col("success"), entries(as_results())).alias("model"), F.col("error").alias("model_error"))
    return page_join(left, right)


def _value_of(found: Column, field: Column) -> Column:
    return F.get(F.filter(found, lambda e: e["field"] == field), F.lit(0))["value"]


def compare_fields(pairs: DataFrame) -> DataFrame:
    """Long form: one row per page and field found by either side."""
    names = F.array_union(
        F.transform("mapping", lambda e: e["field"]), F.transform("model", lambda e: e["field"])
    )  # null, hence no rows, where the model failed
    # what belongs to the page is made before its fields become rows
    paged = pairs.select(
        "page_id", "mapping", "model", "tried", "mapping_confidence", "mapping_errors",
        coverage(F.col("mapping")).alias("mapping_coverage"), coverage(F.col("model")).alias("model_coverage"),
    )
    rows = paged.withColumn("field", F.explode(names)).select(
        "page_id", "field",
        _value_of(F.col("mapping"), F.col("field")).alias("mapping_value"),
        _value_of(F.col("model"), F.col("field")).alias("model_value"),
        F.get(F.filter("tried", lambda t: t["field"] == F.col("field")), F.lit(0))["success"].alias("tried"),
        "mapping_confidence", "mapping_errors", "mapping_coverage", "model_coverage",
    )
    scored = with_similarity(rows, "mapping_value", "model_value")
    m, a = F.col("mapping_value"), F.col("model_value")
    kind = (
        F.when(m.isNull(), F.lit("missing"))
        .when(a.isNull(), F.lit("extra"))
        .when(F.col("similarity") >= 0.9, F.lit("match"))
        .otherwise(F.lit("different"))
    )
    judged = scored.withColumn("difference_type", kind).withColumn(
        "similarity",
        F.when(m.isNull(), 0.0).when(a.isNull(), 0.5).otherwise(F.col("similarity")),
    )
    note = (
        F.when(kind_is("missing"), F.concat(F.lit("Consider adding mapping for '"), F.col("field"), F.lit("': "), a))
        .when(kind_is("extra"), F.concat(F.lit("Mapping found '"), F.col("field"), F.lit("' but AI didn't - verify accuracy")))
        .when(kind_is("different"), F.concat(
            F.lit("Values differ - Mapping: '"), m, F.lit("' vs AI: '"), a, F.lit("'")))
    )
    return judged.select(
        "page_id", "field", field_rank(F.col("field")).alias("field_order"), "mapping_value", "model_value",
        kind_is("match").alias("is_match"), "similarity", "difference_type",
        note.alias("suggestion"),
        F.when(F.col("tried").isNotNull(), F.when(F.col("tried"), 0.8).otherwise(0.0)).alias("confidence"),
        "mapping_confidence", "mapping_errors", "mapping_coverage", "model_coverage",
    )


def kind_is(kind: str) -> Column:
    return F.col("difference_type") == kind


def field_rank(field: Column) -> Column:
    at = F.array_position(F.lit(FIELD_ORDER), field)
    return F.when(at > 0, at - 1).otherwise(999)


def field_weight(field: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SIMILARITY_WEIGHTS.items() for x in pair])
    return F.coalesce(table[field], F.lit(1.0))


def page_scores(comparisons: DataFrame) -> DataFrame:
    """Weighted similarity, coverage, match count and recommendations per page."""
    weight = field_weight(F.col("field"))
    listed = lambda cond: F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct(field_rank(F.col("field")).alias("r"), F.col("field").alias("f"))))),
        lambda s: s["f"],
    )
    agg = comparisons.groupBy("page_id").agg(
        (F.sum(F.col("similarity") * weight) / F.sum(weight)).alias("overall_similarity"),
        F.first("mapping_coverage").alias("mapping_coverage"),
        F.first("model_coverage").alias("model_coverage"),
        F.first("mapping_confidence").alias("mapping_confidence"),
        F.first("mapping_errors").alias("mapping_errors"),
        F.count_if("is_match").alias("matches"),
        F.count("*").alias("fields"),
        F.count_if(kind_is("missing")).alias("missing"),
        F.count_if(kind_is("different")).alias("different"),
        listed(kind_is("missing")).alias("missing_fields"),
        listed(kind_is("missing") & F.col("field").isin(CRITICAL_FIELDS)).alias("critical_fields"),
    )
    advice = F.array_compact(F.array(
        F.when(F.col("missing") > 0, F.concat(
            F.lit("Consider adding mappings for "), F.col("missing"), F.lit(" missing fields: "),
            F.array_join("missing_fields", ", "))),
        F.when(F.col("different") > 0, F.concat(
            F.lit("Review "), F.col("different"), F.lit(" fields with different values - selectors may need refinement"))),
        F.when(F.col("mapping_errors") > 0, F.concat(
            F.lit("Fix "), F.col("mapping_errors"), F.lit(" mapping errors for better accuracy"))),
        F.when(F.col("mapping_confidence") < 0.5, F.lit("Low mapping confidence - consider using AI-suggested selectors")),
        F.when(F.size("critical_fields") > 0, F.concat(
            F.lit("Priority: Add mappings for critical fields: "), F.array_join("critical_fields", ", "))),
    ))
    return agg.select("*", advice.alias("recommendations"))


def page_results(pairs: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row per page: its scores, or why it could not be compared (no rules for its site, no answer)."""
    scores = page_scores(comparisons).drop("mapping_confidence", "mapping_errors")
    none = F.array().cast("array<string>")
    both = F.col("mapping").isNotNull() & F.col("model").isNotNull()
    rows = pairs.select("page_id", both.alias("success"), "mapping_error", "model_error").join(scores, "page_id", "left")
    zeros = {c: F.coalesce(c, F.lit(0.0)) for c in ("overall_similarity", "mapping_coverage", "model_coverage")}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("matches", "fields", "missing", "different")}
    lost = F.concat(F.lit("AI extraction failed: "), F.coalesce("model_error", F.lit("no answer")))
    error = F.when(~F.col("success"), F.coalesce("mapping_error", lost))
    return rows.withColumns(zeros | counts | {"recommendations": F.coalesce("recommendations", none), "error": error}).drop("mapping_error", "model_error")
