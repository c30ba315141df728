"""Extraction for the known site layout: selector cascades over one page row."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.constants import DETAIL_NAMES, SITE_CONFIDENCE, VIN_CLASS
from lotweave.functions import record, values, web
from lotweave.operators.selectors import (
    Step, cascade_sql, element_sql, element_text, first, first_text, let, link_value, owner_node,
    raw_text, select_sql, text_of, texts_of,
)


def _qa(value: str) -> list[Step]:
    return [Step(attr=("data-qa", "=", value))]


def _cls(*names: str, tag: str | None = None) -> list[Step]:
    steps = [Step(cls=n) for n in names]
    return [*steps, Step(tag=tag)] if tag else steps


PRICE_CASCADE = [
    _cls("price-section", "primary-price"),
    [*_qa("price-container"), Step(cls="primary-price")],
    _cls("vdp-price", "primary-price"),
    _cls("price-display", "primary-price"),
    _cls("listing-price"),
]
FEATURE_CASCADE = [
    _cls("vehicle-features", tag="li"),
    _cls("features-list", tag="li"),
    [*_qa("vehicle-features"), Step(tag="li")],
]
IMAGE_CASCADE = [
    _cls("vehicle-photos", tag="img"), _cls("photo-gallery", tag="img"), _cls("listing-images", tag="img"),
]
DETAIL_PATTERNS = [
    (Step(tag="dt"), Step(tag="dd")),
    (Step(cls="key"), Step(cls="value")),
    (Step(cls="label"), Step(cls="data")),
]


def basic() -> Column:
    """Title, year, make, model."""
    title = text_of([Step(tag="h1", cls="listing-title")], [Step(tag="h1", attr=("data-qa", "=", "vdp-vehicle-title"))])

    def read(t: Column) -> Column:
        def merge(p: Column) -> Column:
            return F.struct(
                t.alias("listing_title"),
                F.coalesce(p["year"], values.to_int(text_of(_qa("vehicle-year")))).alias("year"),
                F.coalesce(p["make"], text_of(_qa("vehicle-make"))).alias("make"),
                F.coalesce(p["model"], text_of(_qa("vehicle-model"))).alias("model"),
            )

        return let(values.site_title(t), merge)

    return let(title, read)


def price() -> Column:
    """First selector of the cascade whose text is a price."""
    return F.coalesce(*[values.site_price(text_of(s)) for s in PRICE_CASCADE])


def mileage() -> Column:
    said = let(
        first_text(r"(?iU)\d+,?\d*\s+miles?"),
        lambda t: let(owner_node(t), element_text),
    )
    return values.site_mileage(F.coalesce(text_of(_qa("mileage-value")), said))


def vin() -> Column:
    """VIN element (which must be a VIN as a whole), else the first labelled string."""
    said = let(
        first_text(rf"(?iU)VIN:?\s*({VIN_CLASS}{{17}})"), lambda t: values.any_vin(t["text"])
    )
    return let(
        text_of(_qa("vin-value")), lambda t: F.when(t.isNotNull(), values.full_vin(t)).otherwise(said)
    )


def details() -> Column:
    """Key/value pairs of the details box as array<struct<field, value>>, in order.

    A pattern counts only if it has as many values as keys.
    """
    pairs = []
    for key, value in DETAIL_PATTERNS:
        inside = "filter(slice(nodes, box.id + 1, box.last - box.id), n -> {})"
        name = f"replace(lower({element_sql('k')}), ':', '')"
        zipped = f"zip_with(ks, vs, (k, v) -> named_struct('key', {name}, 'value', {element_sql('v')}))"
        pairs.append(
            f"get(transform(array({inside.format(key.sql('n'))}), ks -> get(transform(array("
            f"{inside.format(value.sql('n'))}), vs -> if(size(ks) = size(vs), {zipped}, array())), 0)), 0)"
        )
    names = ", ".join(f"'{k}', '{v}'" for k, v in DETAIL_NAMES.items())
    named = f"transform(concat({', '.join(pairs)}), p -> named_struct('field', map({names})[p.key], 'value', p.value))"
    kept = f"filter({named}, p -> p.field IS NOT NULL AND p.value <> '')"
    box = f"get({select_sql(_cls('vehicle-details'))}, 0)"
    return F.expr(f"get(transform(array({box}), box -> {kept}), 0)")


def _last(pairs: Column, field: str) -> Column:
    """Later pairs override earlier ones."""
    return F.try_element_at(F.filter(pairs, lambda p: p["field"] == field), F.lit(-1))["value"]


def dealer() -> Column:
    """Name, phone, address and location of the seller."""
    phone = text_of(_qa("dealer-phone"), [Step(tag="a", attr=("href", "^=", "tel:"))])
    address = F.coalesce(first(_qa("dealer-address")), first(_cls("dealer-address")))
    return let(
        address,
        lambda a: F.struct(
            text_of(_qa("dealer-name"), _cls("dealer-name")).alias("dealer_name"),
            values.site_phone(phone).alias("dealer_phone"),
            element_text(a).alias("dealer_address"),
            values.site_location(raw_text(a)).alias("location"),
        ),
    )


def features() -> Column:
    return F.coalesce(texts_of(FEATURE_CASCADE), F.array().cast("array<string>"))


def images(url: Column) -> Column:
    found = F.expr(cascade_sql(IMAGE_CASCADE))
    src = F.filter(F.transform(found, link_value), lambda s: s != "")
    return F.coalesce(
        F.array_distinct(F.transform(src, lambda s: web.absolute(s, url))),
        F.array().cast("array<string>"),
    )


def accidents() -> Column:
    """First string naming an accident decides; comments and scripts say nothing."""
    return let(
        first_text("(?i)accident"),
        lambda t: F.when(
            t.isNotNull(), (t["kind"] == "text") & ~F.contains(F.lower(t["text"]), F.lit("no accident"))
        ),
    )


@cache
def site_vehicle() -> Column:
    """The whole record of a page in the site layout.

    Built once per process: the expression is immutable and large, and building it is what takes time.
    """

    def build(b: Column, d: Column, pairs: Column) -> Column:
        found = {
            "listing_title": b["listing_title"], "year": b["year"], "make": b["make"],
            "model": b["model"], "price": price(), "mileage": mileage(), "vin": vin(),
            "dealer_name": d["dealer_name"], "dealer_phone": d["dealer_phone"],
            "dealer_address": d["dealer_address"], "location": d["location"],
            "features": features(), "images": images(F.col("url")), "accidents": accidents(),
        }
        for field in sorted(set(DETAIL_NAMES.values())):
            found[field] = _last(pairs, field)
        return record.vehicle(found)

    return let(basic(), lambda b: let(dealer(), lambda d: let(details(), lambda p: build(b, d, p))))


def parse_site(dom: DataFrame) -> DataFrame:
    """One vehicle per page, always a success at a fixed confidence."""
    keep = [c for c in dom.columns if c not in ("nodes", "texts")]

    def counted(v: Column) -> Column:
        filled = [v[f].isNotNull().cast("int") for f in record.FIELD_TYPES]
        return F.struct(v.alias("vehicle"), sum(filled[1:], filled[0]).alias("fields_found"))

    return dom.select(*keep, let(site_vehicle(), counted).alias("r")).select(
        *keep, "r.vehicle", F.lit(SITE_CONFIDENCE).alias("confidence"), "r.fields_found"
    )
