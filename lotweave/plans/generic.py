"""Extraction for unknown sites: text patterns and common markup over one page row."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotweave.functions import record, values, web
from lotweave.operators.selectors import (
    Step, blank_to_null, element_sql, let, link_value, only, page_text, strip, text_of,
)

LOW_CONFIDENCE = "Insufficient data for confident parsing"


def title() -> Column:
    """First of h1, title and h2 whose text parses as year make model."""
    return F.coalesce(
        *[let(text_of([Step(tag=t)]), values.text_title) for t in ("h1", "title", "h2")]
    )


def dealer_name() -> Column:
    """First element classed as dealer, seller or contact, if its text is short."""
    texts = [text_of([Step(attr=("class", "*=", w))]) for w in ("dealer", "seller", "contact")]
    return F.coalesce(*[only(t, lambda x: F.length(x) < 100) for t in texts])


def _some(items: Column, limit: int | None) -> Column:
    return items if limit is None else F.slice(items, 1, limit)


def images(url: Column, limit: int | None = None) -> Column:
    """Sources of all images but small ones, absolute where rooted; the first ``limit``, or all."""

    def big(n: Column) -> Column:
        width, height = n.attrs["width"], n.attrs["height"]
        w, h = values.to_int(width), values.to_int(height)  # read only for sized images
        small = (width != "") & (height != "") & ((w < 200) | (w.isNotNull() & (h < 150)))
        return (n.tag == "img") & ~F.coalesce(small, F.lit(False))

    src = F.transform(F.filter(F.col("nodes"), big), link_value)
    full = F.transform(F.filter(src, lambda s: s != ""), lambda s: web.root_relative(s, url))
    return _some(F.array_distinct(full), limit)


def features(limit: int | None = None) -> Column:
    """Items of lists with 3 to 20 entries, 5 to 50 characters long; the first ``limit``, or all."""

    items = "filter(slice(nodes, b.id + 1, b.last - b.id), n -> n.tag = 'li')"
    texts = f"if(size(li) BETWEEN 3 AND 20, transform(li, e -> {element_sql('e')}), array())"
    lists = f"transform(filter(nodes, b -> b.tag IN ('ul', 'ol')), b -> get(transform(array({items}), li -> {texts}), 0))"
    return _some(F.expr(f"filter(flatten({lists}), s -> length(s) BETWEEN 5 AND 50)"), limit)


@cache
def generic_fields() -> Column:
    """Everything the generic route finds on a page.  Built once per process."""

    def read(text: Column) -> Column:
        return let(
            title(),
            lambda t: F.struct(
                values.text_vin(text).alias("vin"),
                values.modal_price(values.text_prices(text)).alias("price"),
                only(values.text_mileage(text), lambda m: m != 0).alias("mileage"),
                t["year"].alias("year"),
                t["make"].alias("make"),
                t["model"].alias("model"),
                t["listing_title"].alias("listing_title"),
                values.text_phone(text).alias("dealer_phone"),
                blank_to_null(dealer_name()).alias("dealer_name"),
                images(F.col("url")).alias("images"),
                features().alias("features"),
            ),
        )

    return let(page_text(), read)


FIELDS = (
    "vin price mileage year make model listing_title dealer_phone dealer_name images features".split()
)


def generic_vehicle(found: Column) -> Column:
    """Record built from the generic fields; null when too little was found."""
    return F.when(
        record.sufficient(found), record.vehicle({f: found[f] for f in FIELDS})
    )


def model_input(limit: int | None = None) -> Column:
    """Page text prepared for a model: side content dropped, short and numeric lines dropped.

    ``limit`` keeps the first so many lines.
    """
    side = F.filter(F.col("nodes"), lambda n: n.tag.isin("nav", "footer", "aside", "header"))
    forms = F.filter(F.col("nodes"), lambda n: n.tag.isin("form", "button", "input"))

    def outside(texts: Column, boxes: Column) -> Column:
        return F.filter(
            texts, lambda t: ~F.exists(boxes, lambda b: (b.id <= t.owner) & (t.owner <= b["last"]))
        )

    def lines(texts: Column) -> Column:
        pieces = F.filter(F.transform(texts, lambda t: strip(t.text)), lambda p: p != "")
        cut = F.transform(F.split(F.array_join(pieces, "\n"), "\n"), strip)
        kept = F.filter(cut, lambda s: (F.length(s) > 5) & ~s.rlike(r"(?U)^\d+$"))
        return F.array_join(_some(kept, limit), "\n")

    def focus(texts: Column) -> Column:
        # a main element inside dropped side content is gone as well
        mains = F.filter(
            F.col("nodes"),
            lambda n: (n.tag == "main")
            & ~F.exists(side, lambda b: (b.id < n.id) & (n.id <= b["last"])),
        )
        return let(
            F.get(mains, F.lit(0)),
            lambda m: lines(
                F.when(
                    m.isNotNull(),
                    F.filter(texts, lambda t: (m.id <= t.owner) & (t.owner <= m["last"])),
                ).otherwise(let(forms, lambda b: outside(texts, b)))
            ),
        )

    shown = F.filter(F.col("texts"), lambda t: t.kind == "text")
    return let(let(side, lambda b: outside(shown, b)), focus)


def parse_generic(dom: DataFrame) -> DataFrame:
    """One result per page: record, confidence, whether a model is needed and what it would read."""
    keep = [c for c in dom.columns if c not in ("nodes", "texts", "parse_errors")]
    scored = dom.select(
        *dom.columns, generic_fields().alias("found")
    ).withColumn("confidence", record.generic_confidence(F.col("found")))
    weak = record.needs_model(F.col("confidence"))
    return scored.select(
        *keep,
        "found",
        generic_vehicle(F.col("found")).alias("vehicle"),
        "confidence",
        (~weak).alias("success"),
        weak.alias("requires_model"),
        F.when(weak, F.lit(LOW_CONFIDENCE)).alias("error"),
        F.when(weak, model_input()).alias("model_input"),
    )
