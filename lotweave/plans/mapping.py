"""Declarative extraction: every rule of a page's site against the page, without a shuffle.

The rule sets join the pages on the site (``lookup_join``: broadcast while small, with salts for many
rule sets, since one site may own a third of all pages).  All selectors of a page are found in one sweep
over its elements; evaluation then stays inside the page row.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.constants import MIN_CONFIDENCE
from lotweave.functions import record, values
from lotweave.operators.lookup import lookup_join
from lotweave.operators.selectors import element_text, let, link_value, raw_text, strip
from lotweave.operators.sweep import found_values, sweep

NO_STRINGS = "array<string>"


def with_rules(dom: DataFrame, rule_sets: DataFrame, salts: int = 1) -> DataFrame:
    """Attach the rule set of ``site_id``; pages of sites without one keep a null."""
    return lookup_join(dom, rule_sets, "site_id", salt_by="page_id", how="left", salts=salts)


def _node(span: Column) -> Column:
    return F.get(F.col("nodes"), span.id - 1)


def with_swept(ruled: DataFrame) -> DataFrame:
    """What each rule of the page's site finds, in order of the rules."""
    return ruled.withColumn("swept", sweep(F.col("rules.steps"), F.col("rules.end")))


def _map_one(r: Column, place: Column) -> Column:
    """Mapping route: every match counts; one match is a value, several are a list."""

    def found(hit: Column) -> Column:
        css = F.transform(hit["spans"], lambda s: raw_text(_node(s)))
        raw = F.when(r["kind"] == "xpath", found_values(hit, r["end"])).otherwise(css)
        return F.transform(raw, values.clean_any)

    def pack(cleaned: Column) -> Column:
        one = F.when(F.size(cleaned) == 1, F.get(cleaned, F.lit(0)))
        single = F.when(one["value"] != "", one)
        return let(
            single,
            lambda s: F.struct(
                r["field"].alias("field"),
                r["ordinal"].alias("ordinal"),
                F.when(s.isNotNull() | (F.size(cleaned) > 1), F.transform(cleaned, lambda c: c["value"]))
                .alias("values"),
                s["value"].alias("value"),
                s["number"].alias("number"),
                F.exists(cleaned, lambda c: c["number"].isNotNull()).alias("has_number"),
                (F.size(cleaned) > 1).alias("is_list"),
                F.coalesce(s.isNotNull() | (F.size(cleaned) > 1), F.lit(False)).alias("success"),
            ),
        )

    static = F.struct(
        r["field"].alias("field"), r["ordinal"].alias("ordinal"), F.array(r["rule"]).alias("values"),
        r["rule"].alias("value"), F.lit(None).cast("int").alias("number"),
        F.lit(False).alias("has_number"), F.lit(False).alias("is_list"), F.lit(True).alias("success"),
    )
    return F.when(r["kind"] == "static", static).otherwise(
        let(let(F.when(r["kind"].isin("css", "xpath"), F.get(F.col("swept"), place)), found), pack)
    )


@cache
def mapped_rules() -> Column:
    """Results of all rules of the page's site.  Built once per process."""
    return F.transform("rules", _map_one)


@cache
def previewed_rules() -> Column:
    """Preview results of all rules but metadata.  Built once per process."""
    both = F.transform("rules", lambda r, i: F.struct(r.alias("rule"), F.get(F.col("swept"), i).alias("hit")))
    shown = F.filter(both, lambda b: ~F.startswith(b["rule"]["field"], F.lit("_")))
    return F.transform(shown, lambda b: _preview_one(b["rule"], b["hit"]))


def map_fields(ruled: DataFrame) -> DataFrame:
    """Per page: results of all rules, confidence and whether a fallback is needed.

    ``fields_total`` counts every key of the mapping, metadata included.
    """
    keep = [c for c in ruled.columns if c not in ("nodes", "texts", "rules")]
    # a generated column: tests of the fields stay above it, and no projection maps the page again
    mapped = with_swept(ruled).select(*keep, F.explode(F.array(mapped_rules())).alias("fields"))
    n = F.size(F.filter("fields", lambda f: f["success"]))
    counted = mapped.select(
        "*",
        F.when(F.col("fields").isNotNull(), n).otherwise(0).alias("fields_mapped"),
        F.when(F.col("fields").isNotNull(), F.size("fields")).otherwise(0).alias("fields_total"),
    )
    confidence = F.when(
        F.col("fields_total") > 0, F.col("fields_mapped") / F.col("fields_total")
    ).otherwise(0.0)
    return counted.withColumn("confidence", confidence).select(
        "*",
        (F.col("fields_mapped") > 0).alias("success"),
        ((F.col("confidence") < MIN_CONFIDENCE) | (F.col("fields_mapped") < 3)).alias("fallback_needed"),
        F.when(
            F.col("fields").isNull(), F.concat(F.lit("No mapping found for site: "), F.col("site_id"))
        ).alias("error"),
    )


def field_values(mapped: DataFrame) -> DataFrame:
    """Long form: one row per rule that found something."""
    rows = mapped.select("page_id", "site_id", F.explode("fields").alias("f")).where("f.success")
    return rows.select(
        "page_id", "site_id", "f.field", "f.values", "f.value", F.col("f.number").alias("value_int"),
        F.size("f.values").alias("n_values"),
    )


def pick(fields: Column, name: str) -> Column:
    """Result of one field by name, null when it found nothing."""
    return F.get(F.filter(fields, lambda f: (f["field"] == name) & f["success"]), F.lit(0))


# --- results to a vehicle ------------------------------------------------------------------


def _as_text(f: Column) -> tuple[Column, Column]:
    ok = f["success"].isNull() | (f["value"].isNotNull() & f["number"].isNull())
    return f["value"], ok


def _as_int(f: Column) -> tuple[Column, Column]:
    n = F.coalesce(f["number"], values.to_int(f["value"]))
    return n, f["success"].isNull() | n.isNotNull()


def _as_list(f: Column) -> tuple[Column, Column]:
    ok = f["success"].isNull() | (f["is_list"] & ~f["has_number"])
    return f["values"], ok


@cache
def to_vehicle(name: str = "fields") -> Column:
    """struct(record_valid, vehicle) from the named mapping results.  Built once per process.

    One field of the wrong shape voids the record.  Nested dealer fields win over flat ones.
    """

    fields = F.col(name)

    def build(p: Column) -> Column:
        nested = p["in_dealer_name"].isNotNull() | p["in_dealer_phone"].isNotNull()
        chosen = {
            "vin": _as_text(p["vin"]), "make": _as_text(p["make"]), "model": _as_text(p["model"]),
            "color": _as_text(p["color"]),
            "year": _as_int(p["year"]), "price": _as_int(p["price"]), "mileage": _as_int(p["mileage"]),
            "dealer_name": _as_text(F.when(nested, p["in_dealer_name"]).otherwise(p["dealer_name"])),
            "dealer_phone": _as_text(F.when(nested, p["in_dealer_phone"]).otherwise(p["dealer_phone"])),
            "features": _as_list(p["features"]), "images": _as_list(p["images"]),
        }
        valid = F.lit(True)
        for _, ok in chosen.values():
            valid = valid & ok
        return let(
            F.coalesce(valid, F.lit(False)),
            lambda v: F.struct(
                v.alias("record_valid"),
                F.when(v, record.vehicle({k: c for k, (c, _) in chosen.items()})).alias("vehicle"),
            ),
        )

    flat = [
        "vin", "make", "model", "color", "year", "price", "mileage", "dealer_name", "dealer_phone",
        "features", "images",
    ]
    picked = F.struct(
        *[pick(fields, n).alias(n) for n in flat],
        pick(fields, "dealer.name").alias("in_dealer_name"),
        pick(fields, "dealer.phone").alias("in_dealer_phone"),
    )
    some = F.exists(fields, lambda f: f["success"])
    return F.when(some, let(picked, build))


def map_vehicles(mapped: DataFrame, fields: str = "fields") -> DataFrame:
    keep = [c for c in mapped.columns if c != fields]
    return mapped.select(*keep, to_vehicle(fields).alias("r")).select(
        *keep, "r.record_valid", "r.vehicle"
    )


def nested(fields: Column) -> Column:
    """Dotted names as nested maps: 'dealer.name' becomes dealer -> name."""
    hits = F.filter(fields, lambda f: f["success"] & F.contains(f["field"], F.lit(".")))
    return F.map_from_entries(
        F.transform(
            F.array_distinct(F.transform(hits, lambda f: F.substring_index(f["field"], ".", 1))),
            lambda head: F.struct(
                head,
                F.map_from_entries(
                    F.transform(
                        F.filter(hits, lambda f: F.substring_index(f["field"], ".", 1) == head),
                        lambda f: F.struct(F.regexp_replace(f["field"], r"^[^.]*\.", ""), f["value"]),
                    )
                ),
            ),
        )
    )


# --- preview -------------------------------------------------------------------------------


def _preview_one(r: Column, hit: Column) -> Column:
    """Preview route: first element for CSS, all results for XPath, cleaned by field name."""
    field = r["field"]
    is_xpath = r["selector_type"] == "xpath"
    kind = F.when(r["kind"].isin("dict", "list", "other", "css", "xpath"), r["kind"]).otherwise("static")

    def fill(raw: Column, n: Column) -> Column:
        cleaned = F.transform(raw, lambda x: values.clean_typed(x, field))
        # an empty CSS value stays an empty string; an empty XPath string becomes null
        kept = F.transform(cleaned, lambda c: c["value"])
        css_first = F.get(raw, F.lit(0))
        value = F.when(is_xpath, F.when(n == 1, F.get(kept, F.lit(0)))).otherwise(
            F.when(css_first == "", F.lit("")).otherwise(F.get(kept, F.lit(0)))
        )
        number = F.when(n == 1, F.get(F.transform(cleaned, lambda c: c["number"]), F.lit(0)))
        error = (
            F.when((r["kind"] == "dict") & (r["selector"] == ""), F.lit("No selector provided"))
            .when(r["steps"].isNull(), F.when(is_xpath, F.lit("XPath extraction failed")).otherwise(F.lit("CSS extraction failed")))
            .when(n == 0, F.when(is_xpath, F.lit("No elements found with XPath")).otherwise(F.lit("No elements found with selector")))
        )
        return let(
            F.struct(value.alias("value"), number.alias("number"), error.alias("error")),
            lambda x: F.struct(
                field.alias("field"), r["ordinal"].alias("ordinal"),
                F.when(x["error"].isNull() & (n > 0), F.when(n > 1, kept).otherwise(F.array(x["value"]))).alias("values"),
                x["value"].alias("value"), x["number"].alias("number"),
                F.exists(cleaned, lambda c: c["number"].isNotNull()).alias("has_number"),
                (n > 1).alias("is_list"),
                F.coalesce(x["error"].isNull() & (x["value"].isNotNull() | (n > 1)), F.lit(False)).alias("success"),
                x["error"].alias("error"), r["selector"].alias("selector"), r["selector_type"].alias("selector_type"),
            ),
        )

    def found(hit: Column) -> Column:
        first_css = F.transform(F.slice(hit["spans"], 1, 1), lambda s: link_value(_node(s)))
        raw = F.when(is_xpath, found_values(hit, r["end"])).otherwise(first_css)
        return let(F.coalesce(raw, F.array().cast(NO_STRINGS)), lambda x: fill(x, F.size(x)))

    static = F.struct(
        field.alias("field"), r["ordinal"].alias("ordinal"), F.array(r["rule"]).alias("values"),
        r["rule"].alias("value"), F.lit(None).cast("int").alias("number"), F.lit(False).alias("has_number"),
        F.lit(False).alias("is_list"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("string").alias("selector"), F.lit("static").alias("selector_type"),
    )
    return F.when(kind == "static", static).otherwise(let(hit, found))


def preview(ruled: DataFrame) -> DataFrame:
    """Per page: preview results, confidence over fields without metadata, collected errors.

    A page of a site without rules has no fields and one error.
    """
    keep = [c for c in ruled.columns if c not in ("nodes", "texts", "rules", "parse_errors")]
    shown = F.when(F.col("rules").isNotNull(), previewed_rules())
    rows = with_swept(ruled).select(*keep, F.explode(F.array(shown)).alias("fields"))  # generated, as in map_fields
    lost = F.array(F.concat(F.lit("No mapping found for site: "), F.coalesce("site_id", F.lit(""))))
    n = F.coalesce(F.size(F.filter("fields", lambda f: f["success"])), F.lit(0))
    total = F.when(F.col("fields").isNull(), 0).otherwise(F.size("fields"))
    n = F.when(F.col("fields").isNull(), 0).otherwise(n)
    failed = F.filter("fields", lambda f: ~f["success"] & f["error"].isNotNull())
    return rows.select(
        "*",
        n.alias("successful_fields"),
        total.alias("total_fields"),
        F.when(total > 0, n / total).otherwise(0.0).alias("confidence"),
        (n > 0).alias("success"),
        F.coalesce(F.transform(failed, lambda f: F.concat(f["field"], F.lit(": "), f["error"])), lost).alias("errors"),
    )


def extracted_data(fields: Column) -> Column:
    """What was found, as a JSON document: numbers, texts, lists, and dotted fields under their head."""
    hits = F.filter(fields, lambda f: f["success"])

    def value(f: Column) -> Column:
        one = F.when(f["number"].isNotNull(), f["number"].cast("variant")).otherwise(f["value"].cast("variant"))
        return F.when(f["is_list"], F.to_variant_object(f["values"])).otherwise(one)

    flat = F.filter(hits, lambda f: ~F.contains(f["field"], F.lit(".")))
    plain = F.map_from_entries(F.transform(flat, lambda f: F.struct(f["field"], value(f))))
    heads = F.transform_values(nested(fields), lambda _, inner: F.to_variant_object(inner))
    return F.to_json(F.map_concat(F.map_filter(plain, lambda k, _: ~F.array_contains(F.map_keys(heads), k)), heads))


def preview_documents(previews: DataFrame) -> DataFrame:
    """Per page: what a preview found as a document, and the goal document it makes, if it makes one.

    A field of the wrong shape voids the goal, as it voids the record; a page of a site without rules
    has an empty document.
    """
    built = previews.select("page_id", "site_id", "success", "fields", to_vehicle().alias("r"))
    return built.select(
        "page_id", "site_id", "success", F.coalesce(extracted_data(F.col("fields")), F.lit("{}")).alias("extracted_data"),
        F.when(F.col("r.record_valid"), record.goal_json(F.col("r.vehicle"))).alias("goal"),
    )


def preview_rows(previews: DataFrame) -> DataFrame:
    return previews.select("page_id", "site_id", F.explode("fields").alias("f")).select(
        "page_id", "site_id", "f.field", "f.success", "f.value", "f.values",
        F.col("f.number").alias("value_int"), "f.selector", "f.selector_type", "f.error",
    )


def test_selector(dom: DataFrame, steps: Column, kind: Column, end: Column) -> DataFrame:
    """Matches of one selector per page and their whole texts."""

    def texts_of(hit: Column) -> Column:
        css = F.transform(hit["spans"], lambda s: element_text(_node(s)))
        return F.when(kind == "xpath", F.transform(found_values(hit, end), strip)).otherwise(css)

    keep = [c for c in dom.columns if c not in ("nodes", "texts")]
    swept = dom.withColumn("swept", F.get(sweep(F.array(steps), F.array(end)), F.lit(0)))
    hit = swept.select(*keep, let(F.col("swept"), texts_of).alias("all_texts"))
    n = F.when(F.col("all_texts").isNull(), 0).otherwise(F.size("all_texts"))
    return hit.select(
        *keep, n.alias("matches"), (n > 0).alias("success"),
        F.col("all_texts").alias("texts"),
        F.when(n == 0, F.lit("No elements found")).alias("error"),
    )
