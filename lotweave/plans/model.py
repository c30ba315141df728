"""Model answers: prompt text, answer parsing, field cleaning, scoring and merging.

Answers are an input table (page_id, model_used, tokens_used, response); calling a model is the
caller's business.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.constants import ARRAY_FIELDS, INT_FIELDS, STRING_FIELDS
from lotweave.functions import record
from lotweave.operators.selectors import let, only, strip

PARSE_ERROR = "Failed to parse AI response as valid JSON"
NO_TEXT = "array<string>"

_ASK = (
    "Read the vehicle listing below and answer with one JSON object and nothing else.\n"
    f"Text keys: {', '.join(STRING_FIELDS)}.\nWhole-number keys: {', '.join(INT_FIELDS)}.\n"
    f"List keys: {', '.join(ARRAY_FIELDS)}.\nTrue/false key: accidents.\n"
    "Use null for what the listing does not say; write numbers without signs or separators."
)


def prompt(url: Column, content: Column, existing: Column) -> Column:
    """Question for a model: task, page address, page text and what is already known."""
    known = F.when(existing.isNotNull(), F.concat(F.lit("\n\nAlready found (check and extend):\n"), existing))
    return F.concat(
        F.lit(_ASK), F.lit("\n\nAddress: "), F.coalesce(url, F.lit("")),
        F.lit("\n\nPage text:\n"), F.coalesce(content, F.lit("")), F.coalesce(known, F.lit("")),
    )


def selector_prompt(html: Column, fields: list[tuple[str, str]], limit: int | None = None) -> Column:
    """Question asking for selectors of the given (field, description) pairs; ``limit`` is in characters of the page."""
    wanted = "\n".join(f"- {name}: {text}" for name, text in fields)
    shown = html
    if limit is not None:
        shown = F.when(F.length(html) > limit, F.concat(F.substring(html, 1, limit), F.lit("..."))).otherwise(html)
    return F.concat(F.lit(f"Name a stable selector for each field:\n{wanted}\n\nPage:\n"), shown)


def answer_json(response: Column) -> Column:
    """Widest {...} of an answer as a variant, else the whole answer; null when it is no object."""

    def parse(found: Column) -> Column:
        text = F.when(found != "", found).otherwise(strip(response))
        return only(
            F.try_parse_json(text), lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
        )

    return let(F.regexp_extract(response, r"(?s)\{.*\}", 0), parse)


def _shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _string(v: Column) -> Column:
    text = F.when(_shape(v) == "STRING", strip(F.try_variant_get(v, "$", "string")))
    return only(text, lambda t: t != "")


def _int(v: Column) -> Column:
    def read(shape: Column) -> Column:
        digits = F.regexp_replace(F.try_variant_get(v, "$", "string"), r"[^0-9]", "")
        whole = F.try_variant_get(v, "$", "double").try_cast("int")
        return (
            F.when(shape == "STRING", digits.try_cast("int"))
            .when(shape == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int"))
            .when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), whole)
        )

    return let(_shape(v), read)


def _flag(v: Column) -> Column:
    def read(shape: Column) -> Column:
        said = F.lower(F.try_variant_get(v, "$", "string")).isin("true", "yes", "1")
        return F.when(shape == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(
            shape == "STRING", said
        )

    return let(_shape(v), read)


def _list(v: Column) -> Column:
    items = F.transform(
        F.try_variant_get(v, "$", "array<variant>"), lambda i: F.try_variant_get(i, "$", "string")
    )
    kept = F.filter(F.transform(items, strip), lambda s: s != "")
    return F.when(
        F.startswith(_shape(v), F.lit("ARRAY")), only(kept, lambda k: F.size(k) > 0)
    )


def clean_fields(doc: Column) -> Column:
    """Typed, trimmed fields of an answer document."""
    get = lambda name: F.try_variant_get(doc, f"$.{name}", "variant")
    cols = [_string(get(f)).alias(f) for f in STRING_FIELDS]
    cols += [_int(get(f)).alias(f) for f in INT_FIELDS]
    cols += [_flag(get("accidents")).alias("accidents")]
    cols += [_list(get(f)).alias(f) for f in ARRAY_FIELDS]
    return F.struct(*cols)


def field_count(fields: Column) -> Column:
    names = [*STRING_FIELDS, *INT_FIELDS, "accidents", *ARRAY_FIELDS]
    parts = [fields[f].isNotNull().cast("int") for f in names]
    return sum(parts[1:], parts[0])


@cache
def judged_answer() -> Column:
    """struct(fields, field_count, confidence) of ``response``.  Built once per process."""

    def judge(f: Column) -> Column:
        n = field_count(f)
        return F.struct(
            F.when(n > 0, f).alias("fields"), n.alias("field_count"),
            F.when(n > 0, record.model_confidence(f)).alias("confidence"),
        )

    doc = answer_json(F.col("response"))
    return let(doc, lambda d: F.when(d.isNotNull(), let(clean_fields(d), judge)))


def parse_answers(answers: DataFrame) -> DataFrame:
    """Per answer: cleaned fields, success, confidence and error."""
    keep = [c for c in answers.columns if c != "response"]
    # a generated column: a filter on what was parsed stays above it, and no projection parses again
    judged = answers.select(*keep, F.explode(F.array(judged_answer())).alias("r")).select(
        *keep, "r.fields", F.coalesce("r.field_count", F.lit(0)).alias("field_count"), "r.confidence"
    )
    ok = F.col("fields").isNotNull()
    return judged.select("*", ok.alias("success"), F.when(~ok, F.lit(PARSE_ERROR)).alias("error"))


def vehicle_of(fields: Column) -> Column:
    names = [*STRING_FIELDS, *INT_FIELDS, "accidents", *ARRAY_FIELDS]
    return F.when(fields.isNotNull(), record.vehicle({f: fields[f] for f in names}))


def goal_metadata(model: Column, confidence: Column, tokens: Column) -> Column:
    return F.struct(
        F.lit("ai").alias("extraction_method"), model.alias("ai_model"),
        confidence.alias("confidence"), tokens.alias("tokens_used"),
    )


@cache
def as_results(column: str = "fields") -> Column:
    """Model fields in the shape of mapping results, absent fields left out.  Built once per process."""
    fields = F.col(column)

    def item(name: str, value: Column, values: Column, number: Column, is_list: bool) -> Column:
        return F.when(
            fields[name].isNotNull(),
            F.struct(
                F.lit(name).alias("field"), F.lit(0).alias("ordinal"), values.alias("values"),
                value.alias("value"), number.alias("number"), F.lit(False).alias("has_number"),
                F.lit(is_list).alias("is_list"), F.lit(True).alias("success"),
            ),
        )

    none_text, none_int = F.lit(None).cast("string"), F.lit(None).cast("int")
    out = [item(f, fields[f], F.array(fields[f]), none_int, False) for f in STRING_FIELDS]
    for f in INT_FIELDS:
        text = fields[f].cast("string")
        out.append(item(f, text, F.array(text), fields[f], False))
    flag = F.initcap(fields["accidents"].cast("string"))
    out.append(item("accidents", flag, F.array(flag), none_int, False))
    out += [item(f, none_text, fields[f], none_int, True) for f in ARRAY_FIELDS]
    return F.array_compact(F.array(*out))


def merge(mapped: DataFrame, answers: DataFrame) -> DataFrame:
    """Mapping results overridden by model fields where the mapping fell short.

    Only rows flagged for fallback look up an answer, and they carry results, not page bodies.
    Failed answers stay as nulls: a filter on them would be pushed below the parsing and parse twice.
    """
    given = answers.select(
        "page_id", F.when(F.col("success"), as_results()).alias("_given"), F.col("confidence").alias("_conf")
    )
    joined = mapped.join(given, (mapped.page_id == given.page_id) & mapped.fallback_needed, "left").drop(
        given.page_id
    )
    used = F.col("_given").isNotNull()
    base = F.coalesce(
        F.transform("fields", lambda f: F.struct(
            f["field"].alias("field"), f["ordinal"].cast("int").alias("ordinal"), f["values"].alias("values"),
            f["value"].alias("value"), f["number"].alias("number"), f["has_number"].alias("has_number"),
            f["is_list"].alias("is_list"), f["success"].alias("success"))),
        F.array().cast(
            "array<struct<field:string,ordinal:int,values:array<string>,value:string,number:int,"
            "has_number:boolean,is_list:boolean,success:boolean>>"
        ),
    )
    merged = F.concat(F.coalesce(F.col("_given"), F.slice(base, 1, 0)), base)
    return joined.select(
        *[c for c in mapped.columns if c not in ("fields", "confidence")],
        merged.alias("fields"),
        F.coalesce(F.greatest("confidence", "_conf"), F.col("confidence")).alias("confidence"),
        used.alias("model_used"),
    )
