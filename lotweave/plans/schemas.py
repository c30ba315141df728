"""Mapping configs as data: listing, validation, creation and update over (site_id, config) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotweave.functions.xpath import valid_xpaths
from lotweave.operators.dom import with_dom
from lotweave.operators.selectors import selector_ok
from lotweave.plans import mapping, rollup
from lotweave.session import written
from lotweave.sources.pages import fetch_urls
from lotweave.sources.rules import rule_rows

REQUIRED = ["vin", "goal"]
PRICE_WORDS = ["price", "cost", "msrp"]


def _all_missing() -> Column:
    return F.array(*[F.lit(f"Missing required field: {f}") for f in REQUIRED])


def readable(config: Column) -> Column:
    """Is the text a JSON object?"""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(config)), F.lit("OBJECT")), F.lit(False))


def _messages(col: Column) -> Column:
    return F.array_sort(F.collect_list(col))


def _missing(field: str) -> Column:
    absent = F.count_if(F.col("field") == field) == 0
    return F.when(absent, F.lit(f"Missing required field: {field}"))


def validate_mapping(configs: DataFrame) -> DataFrame:
    """Per site: errors, warnings and number of keys, metadata included.

    An XPath rule is an error if it is no XPath at all, and a warning if extraction can't evaluate it.
    Unreadable configs come back invalid with no count instead of failing the whole report; an empty
    one misses its required fields.
    """
    rules = rule_rows(configs)
    listed = F.from_json("rule", "array<string>")
    written = F.when(F.col("kind") == "xpath", F.array("selector")).when(F.col("kind") == "list", listed)
    rules = rules.withColumn("paths", F.when(~F.startswith("field", F.lit("_")), F.filter(written, lambda t: F.startswith(t, F.lit("/")))))
    rules = rules.withColumn("path_ok", valid_xpaths(F.col("paths")))
    invalid = F.filter("paths", lambda t, i: ~F.get(F.col("path_ok"), i))
    apart = F.filter("paths", lambda t, i: F.get(F.col("path_ok"), i) & ~selector_ok(t, F.lit("xpath")))
    named = F.lower(F.col("rule")).rlike("|".join(PRICE_WORDS)) & F.col("kind").isin("css", "xpath", "static", "list")
    off_price = (F.count_if(F.col("field") == "price") > 0) & (F.count_if((F.col("field") == "price") & named) == 0)

    def told(texts: Column, start: str, middle: str) -> Column:
        lines = F.transform(texts, lambda t: F.concat(F.lit(start), F.col("field"), F.lit(middle), t))
        return F.array_sort(F.flatten(F.collect_list(F.coalesce(lines, F.array().cast("array<string>")))))

    report = rules.groupBy("site_id").agg(
        F.count("*").cast("int").alias("fields_count"),
        F.array_compact(F.concat(F.array(*[_missing(f) for f in REQUIRED]), told(invalid, "Invalid selector for ", ": "))).alias("errors"),
        F.array_compact(
            F.concat(
                F.array(F.when(off_price, F.lit("Price selector might not target price element"))),
                told(apart, "Selector for ", " is valid but not evaluated: "),
            )
        ).alias("warnings"),
    )
    lost = F.array(F.concat(F.lit("Mapping not found for site: "), F.col("site_id")))
    return (
        configs.select("site_id", readable(F.col("config")).alias("_readable")).join(report, "site_id", "left")
        .withColumn("errors", F.coalesce("errors", F.when(F.col("_readable"), _all_missing()).otherwise(lost)))
        .select(
            "site_id",
            (F.size("errors") == 0).alias("valid"),
            "errors",
            F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
            F.coalesce("fields_count", F.when(F.col("_readable"), F.lit(0))).alias("fields_count"),
        )
    )


def validate_config(configs: DataFrame, key: str = "site_id") -> DataFrame:
    """Per site (or other key): structural errors and warnings, counting fields without metadata.

    Every config has a row: an empty one misses its required fields, one that is no JSON object is
    unreadable.
    """
    rules = rule_rows(configs, key)
    shown = ~F.startswith("field", F.lit("_"))
    quoted = F.concat(F.lit("Field '"), F.col("field"), F.lit("'"))
    no_selector = shown & (F.col("kind") == "dict") & ~F.col("has_selector")
    bad_type = shown & (F.col("kind") == "dict") & ~F.col("given_type").isin("css", "xpath")
    bad_kind = shown & F.col("kind").isin("list", "other")
    empty = shown & (F.col("rule") == "") & (F.col("field") != "goal") & (F.col("kind") == "static")
    report = rules.groupBy(key).agg(
        F.array_compact(
            F.concat(
                F.array(*[_missing(f) for f in REQUIRED]),
                _messages(F.when(no_selector, F.concat(quoted, F.lit(" missing selector")))),
                _messages(F.when(bad_type, F.concat(quoted, F.lit(" has invalid type: "), F.col("given_type")))),
                _messages(F.when(bad_kind, F.concat(quoted, F.lit(" has invalid configuration type")))),
            )
        ).alias("errors"),
        _messages(F.when(empty, F.concat(quoted, F.lit(" has empty selector")))).alias("warnings"),
        F.count_if(shown).cast("int").alias("field_count"),
    )
    whole = configs.select(key, readable(F.col("config")).alias("_readable")).join(report, key, "left")
    return whole.select(
        key,
        F.coalesce("errors", F.when(F.col("_readable"), _all_missing()).otherwise(F.array(F.lit("unreadable")))).alias("errors"),
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.coalesce("field_count", F.when(F.col("_readable"), F.lit(0))).alias("field_count"),
    ).withColumn("valid", F.size("errors") == 0)


def mapping_info(configs: DataFrame) -> DataFrame:
    """Per site: fields in order, their number, all rules in order and the outcome of the validation."""
    entry = F.struct("ordinal", "field", "rule")
    rows = rule_rows(configs).groupBy("site_id").agg(
        F.array_sort(F.collect_list(entry), lambda a, b: a["ordinal"] - b["ordinal"]).alias("entries")
    )
    checks = validate_mapping(configs).select("site_id", F.struct("valid", "errors", "warnings").alias("validation"))
    return checks.join(rows, "site_id", "left").select(
        "site_id",
        F.transform("entries", lambda e: e["field"]).alias("fields"),
        F.when(F.col("entries").isNotNull(), F.size("entries")).alias("field_count"),
        F.transform("entries", lambda e: F.struct(e["field"].alias("field"), e["rule"].alias("rule"))).alias("selectors"),
        "validation",
    )


def available_sites(configs: DataFrame) -> DataFrame:
    return rule_rows(configs).select("site_id").distinct().orderBy("site_id")


def list_schemas(configs: DataFrame) -> DataFrame:
    """Readable schemas with their whole metadata (JSON) and number of fields; rows are to be counted by the caller."""
    doc = F.try_parse_json("config")
    return configs.where(readable(F.col("config"))).select(
        "site_id",
        F.try_variant_get(doc, "$._metadata.version", "string").alias("version"),
        F.to_json(F.try_variant_get(doc, "$._metadata", "variant")).alias("metadata"),
        F.size(F.filter(F.json_object_keys("config"), lambda k: ~F.startswith(k, F.lit("_")))).alias("field_count"),
    )


def get_schema(configs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested schemas, with an error where there is none."""
    return wanted.join(configs, "site_id", "left").select(
        "site_id", "config",
        F.when(F.col("config").isNull(), F.concat(F.lit("Schema not found: "), F.col("site_id"))).alias("error"),
    )


def _stamped(config: Column, meta: dict[str, Column]) -> Column:
    """Config text with its metadata replaced by the given entries over the old ones."""
    body = F.map_filter(F.from_json(config, "map<string,variant>"), lambda k, _: k != "_metadata")
    none = F.create_map().cast("map<string,variant>")
    old = F.coalesce(F.from_json(F.get_json_object(config, "$._metadata"), "map<string,variant>"), none)
    kept = F.map_filter(old, lambda k, _: ~k.isin(list(meta)))  # values keep their types
    new = F.create_map(*[x for k, v in meta.items() for x in (F.lit(k), F.to_json(F.array(v)))])
    new = F.transform_values(new, lambda _, v: F.try_variant_get(F.parse_json(v), "$[0]", "variant"))
    full = F.map_concat(body, F.create_map(F.lit("_metadata"), F.to_variant_object(F.map_concat(kept, new))))
    return F.to_json(full)


def _judged(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """Requests with their validity and what stands against them, each judged on its own.

    ``asked`` has op (create or update; create where there is no such column), site_id, config and
    request_no, the order in which a site's requests apply; without numbers they go by their config's
    text.  A site is there from its first valid creation on, so one number per site says which requests
    find it: no site's requests are brought together.
    """
    rows = asked if "op" in asked.columns else asked.withColumn("op", F.lit("create"))
    if "request_no" not in asked.columns:
        rows = rows.withColumn("request_no", F.row_number().over(Window.partitionBy("site_id").orderBy("config")).cast("long"))
    rows = rows.select("request_no", "op", "site_id", "config").distinct()
    keyed = rows.withColumn("request", F.struct("site_id", "request_no", F.xxhash64("config").alias("text")))
    checks = validate_config(keyed.select("request", "config").dropDuplicates(["request"]), "request").select("request", "valid", "errors")
    judged = keyed.join(checks, "request", "left").withColumn("ok", F.coalesce("valid", F.lit(False)))
    first = judged.where("op = 'create' AND ok").groupBy("site_id").agg(F.min("request_no").alias("first"))
    there = existing.select("site_id", F.lit(True).alias("there")).distinct()
    judged = judged.join(there, "site_id", "left").join(first, "site_id", "left")
    found = F.coalesce(F.col("there"), F.lit(False)) | F.coalesce(F.col("request_no") > F.col("first"), F.lit(False))
    made = F.col("op") == "create"
    status = (
        F.when(made & found, F.lit("conflict")).when(~made & ~found, F.lit("missing"))
        .when(~F.col("ok"), F.lit("invalid")).when(made, F.lit("created")).otherwise(F.lit("updated"))
    )
    return judged.withColumn("status", status).drop("request", "there", "first", "valid", "ok")


def schema_outcomes(existing: DataFrame, asked: DataFrame) -> DataFrame:
    """One row per request: (request_no, op, site_id, status, error); equal rows are one request."""
    site = F.col("site_id")
    told = {
        "conflict": F.concat(F.lit("Schema already exists: "), site), "missing": F.concat(F.lit("Schema not found: "), site),
        "invalid": F.concat(F.lit("Invalid schema: "), F.array_join(F.coalesce("errors", F.array(F.lit("unreadable"))), ", ")),
    }
    error = F.coalesce(*[F.when(F.col("status") == k, text) for k, text in told.items()])
    return _judged(existing, asked).select("request_no", "op", "site_id", "status", error.alias("error"))


def _stamps(by: str, word: str, version: Column) -> dict[str, Column]:
    return {"site_id": F.col("site_id"), f"{word}_by": F.lit(by), f"{word}_at": F.unix_timestamp().cast("string"), "version": version}


def create_schemas(existing: DataFrame, asked: DataFrame, created_by: str = "lotweave") -> DataFrame:
    """Outcome of each request to create (site_id, config): created, conflict or invalid, with the stamped config."""
    rows = _judged(existing, asked.drop("op"))
    told = schema_outcomes(existing, asked.drop("op")).select("request_no", "site_id", "status", "error").distinct()
    stamped = F.when(F.col("status") == "created", _stamped(F.col("config"), _stamps(created_by, "created", F.lit("1.0.0"))))
    made = rows.select("request_no", "site_id", "status", stamped.alias("config"))
    return made.join(told, ["request_no", "site_id", "status"]).select("request_no", "site_id", "status", "error", "config")


def applied_schemas(existing: DataFrame, asked: DataFrame, by: str = "lotweave") -> DataFrame:
    """The whole table (site_id, config, changed) after all requests, each against what the one before left.

    An update replaces the rules; it keeps the metadata that it brings none of, and never the version.
    So a site's last valid update gives its rules, and the last one with metadata, or what was there
    first, its metadata.
    """
    rows = _judged(existing, asked)
    created = rows.where("status = 'created'").select(
        "site_id", _stamped(F.col("config"), _stamps(by, "created", F.lit("1.0.0"))).alias("config"), F.lit(True).alias("changed")
    )
    base = existing.select("site_id", "config", F.lit(False).alias("changed")).unionByName(created)
    own = F.get_json_object("config", "$._metadata")
    last = rows.where("status = 'updated'").groupBy("site_id").agg(
        F.max_by("config", "request_no").alias("rules"),
        F.max_by(own, F.when(own.isNotNull(), F.col("request_no"))).alias("meta"),
    )
    both = base.join(last, "site_id", "left")
    version = F.coalesce(F.get_json_object("config", "$._metadata.version"), F.lit("1.0.0"))
    meta = F.coalesce("meta", own)
    body = F.when(F.get_json_object("rules", "$._metadata").isNotNull() | meta.isNull(), F.col("rules")).otherwise(
        F.concat(F.lit('{"_metadata": '), meta, F.lit(", "), F.regexp_replace("rules", r"^\s*\{", ""))
    )
    merged = both.withColumn("version", version).withColumn("merged", body)
    new = _stamped(F.col("merged"), _stamps(by, "updated", F.col("version")))
    return merged.select(
        "site_id", F.when(F.col("rules").isNotNull(), new).otherwise(F.col("config")).alias("config"), (F.col("changed") | F.col("rules").isNotNull()).alias("changed")
    )


def update_schemas(existing: DataFrame, asked: DataFrame, updated_by: str = "lotweave") -> DataFrame:
    """The whole table (site_id, config, updated) after updates: replaced where valid and present, otherwise as before."""
    return applied_schemas(existing, asked.withColumn("op", F.lit("update")), updated_by).withColumnRenamed("changed", "updated")


def test_schemas(tests: DataFrame, pages: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """One row per tested (site_id, url): what the site's rules find on the page, or why there is nothing.

    Each URL is looked up once; pages join the slim list of tests, which Spark broadcasts while small.
    """
    found = fetch_urls(tests, pages).select("url", "page_id", F.col("error").alias("fetch_error"))
    placed = tests.select("site_id", "url").distinct().join(found, "url", "left")
    known = rule_sets.select("site_id", F.lit(True).alias("_known"))
    placed = written(placed.join(known, "site_id", "left"), "tests")  # read twice: URLs are looked up once
    asked = placed.where("page_id IS NOT NULL AND _known").select("page_id", "site_id")
    shown = mapping.preview(mapping.with_rules(with_dom(pages.select("page_id", "html").join(asked, "page_id")), rule_sets))
    results = shown.select("page_id", "site_id", "success", "successful_fields", "total_fields", "confidence", "errors")
    out = placed.join(results, ["page_id", "site_id"], "left")
    unknown = F.concat(F.lit("Schema not found: "), F.coalesce("site_id", F.lit("")))
    return out.select(
        "site_id", "url", F.coalesce("success", F.lit(False)).alias("success"),
        F.coalesce("successful_fields", F.lit(0)).alias("fields_extracted"), F.coalesce("total_fields", F.lit(0)).alias("total_fields"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "errors",
        F.when(F.col("_known").isNull(), unknown)
        .when(F.col("page_id").isNull(), F.concat(F.lit("Failed to fetch: "), F.coalesce("fetch_error", F.lit("")))).alias("error"),
    )


def success_rates(results: DataFrame) -> DataFrame:
    """Tests, successes and their share per site, failures to fetch counted."""
    return rollup.merged_rates(rollup.rate_state(results))
