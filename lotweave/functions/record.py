"""The vehicle record: range rules, goal text, goal document and confidence scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.constants import (
    ARRAY_FIELDS, GENERIC_POINTS, GOAL_KEYS, INT_FIELDS, MIN_CONFIDENCE, MODEL_POINTS,
    STRING_FIELDS,
)
from lotweave.operators.selectors import only

FIELD_TYPES = {
    **{f: "string" for f in STRING_FIELDS},
    **{f: "int" for f in INT_FIELDS},
    "dealer_rating": "double",
    "accidents": "boolean",
    **{f: "array<string>" for f in ARRAY_FIELDS},
}


def checked(name: str, value: Column) -> Column:
    """Null out values outside a field's range."""
    rules = {
        "price": lambda v: v > 0,
        "year": lambda v: v.between(1900, 2030),
        "mileage": lambda v: v >= 0,
        "dealer_rating": lambda v: v.between(0, 5),
    }
    return only(value, rules[name]) if name in rules else value


def vehicle(values: Mapping[str, Column]) -> Column:
    """A full vehicle struct from the fields at hand; absent ones are null, lists empty."""
    out = []
    for name, kind in FIELD_TYPES.items():
        value = values.get(name)
        col = F.lit(None).cast(kind) if value is None else checked(name, value.cast(kind))
        if name in ARRAY_FIELDS:
            col = F.coalesce(col, F.array().cast(kind))
        out.append(col.alias(name))
    return F.struct(*out)


def goal_text(v: Column) -> Column:
    """One sentence naming the vehicle, its condition and price."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    make, model, title = v["make"], v["model"], v["listing_title"]
    has_year = F.coalesce(v["year"] != 0, F.lit(False))
    what = (
        F.when(has_year & filled(make) & filled(model), F.concat_ws(" ", v["year"].cast("string"), make, model))
        .when(filled(make) & filled(model), F.concat_ws(" ", make, model))
        .when(filled(title), title)
        .otherwise(F.lit("vehicle"))
    )
    use = F.when((v["mileage"] != 0) & (v["mileage"] < 30_000), F.lit("low-mileage")).when(
        v["mileage"] > 100_000, F.lit("high-mileage")
    )
    clean = F.when(v["accidents"] == F.lit(False), F.lit("clean"))
    cost = F.when(v["price"] != 0, F.concat(F.lit(" for $"), F.format_number(v["price"], 0)))
    return F.concat(
        F.lit("Buy a "), F.concat_ws(" ", use, clean, what), F.coalesce(cost, F.lit(""))
    )


def goal_struct(v: Column, metadata: Column | None = None, image_limit: int | None = None) -> Column:
    """The goal document, with the first ``image_limit`` images or all; nulls vanish when it is written as JSON."""
    special = {
        "goal": goal_text(v),
        "dealer": F.when(
            v["dealer_name"] != "",
            F.struct(
                v["dealer_name"].alias("name"),
                v["dealer_phone"].alias("phone"),
                v["dealer_address"].alias("address"),
            ),
        ),
        "images": v["images"] if image_limit is None else F.slice(v["images"], 1, image_limit),
    }
    out = [special.get(k, v[k] if k not in special else None).alias(k) for k in GOAL_KEYS]
    if metadata is not None:
        out.append(metadata.alias("_metadata"))
    return F.struct(*out)


def goal_json(v: Column, metadata: Column | None = None, image_limit: int | None = None) -> Column:
    return F.when(v.isNotNull(), F.to_json(goal_struct(v, metadata, image_limit)))


def _filled(value: Column, name: str) -> Column:
    if name in ARRAY_FIELDS:
        test = F.size(value) > 0
    elif name in INT_FIELDS:
        test = value != 0
    else:
        test = value != ""
    return F.coalesce(test, F.lit(False))


def _points(values: Mapping[str, Column] | Column, table: Mapping[str, int]) -> Column:
    total = F.lit(0)
    for name, points in table.items():
        total = total + F.when(_filled(values[name], name), points).otherwise(0)
    return F.least(total, F.lit(100))


def sufficient(values: Mapping[str, Column] | Column) -> Column:
    """At least two of VIN, price and make."""
    n = sum((_filled(values[f], f).cast("int") for f in ("vin", "price", "make")), F.lit(0))
    return n >= 2


def generic_confidence(values: Mapping[str, Column] | Column) -> Column:
    """Weighted presence score in hundredths, so that 0.7 is compared exactly."""
    return F.when(sufficient(values), _points(values, GENERIC_POINTS)).otherwise(0) / 100.0


def model_confidence(values: Mapping[str, Column] | Column) -> Column:
    return _points(values, MODEL_POINTS) / 100.0


def needs_model(confidence: Column) -> Column:
    return confidence < MIN_CONFIDENCE


def confidence_band(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.8, F.lit("high"))
        .when(confidence >= 0.6, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def coerced(raw: Mapping[str, Column]) -> Column:
    """struct(record_valid, vehicle) from text values; one unreadable value voids the record."""
    cast = {f: v.try_cast(FIELD_TYPES[f]) for f, v in raw.items()}
    valid = F.lit(True)
    for f, v in raw.items():
        valid = valid & (v.isNull() | cast[f].isNotNull())
    return F.struct(
        valid.alias("record_valid"), F.when(valid, vehicle(cast)).alias("vehicle")
    )
