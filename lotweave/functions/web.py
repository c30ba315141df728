"""URLs, inputs and page checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.constants import (
    DOMAIN_MARKS, ERROR_PHRASES, SEARCH_TEMPLATE, SUPPORTED_DOMAINS, VEHICLE_WORDS, VIN_CLASS,
)
from lotweave.operators.selectors import blank_to_null, let, strip


def domain(url: Column) -> Column:
    """Lower-case authority without a leading www., null where the URL has none."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", "")


def is_url(url: Column) -> Column:
    """Absolute http(s) URL with a dotted host (or localhost)."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(
        url.rlike(r"^https?://") & host.isNotNull() & (host.rlike(r"\.[^.]+$") | (host == "localhost")),
        F.lit(False),
    )


def is_supported(dom: Column) -> Column:
    return F.coalesce(dom.isin(SUPPORTED_DOMAINS), F.lit(False))


def clean_vin(vin: Column) -> Column:
    return F.upper(strip(F.coalesce(vin, F.lit(""))))


def is_vin(vin: Column) -> Column:
    return clean_vin(vin).rlike(f"^{VIN_CLASS}{{17}}$")


def search_query(vin: Column) -> Column:
    before, after = SEARCH_TEMPLATE.split("{vin}")
    return F.concat(F.lit(before), clean_vin(vin), F.lit(after))


def input_type(value: Column) -> Column:
    """Route of a request value: url or vin."""
    v = strip(value)
    return (
        F.when(v.rlike(r"^(https?://|www\.)"), F.lit("url"))
        .when(v.rlike(r"(?U)^[\p{L}\p{N}]{17}$"), F.lit("vin"))
        .when(v.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]"), F.lit("url"))
        .otherwise(F.lit("vin"))
    )


def route_error(kind: Column) -> Column:
    return F.when(
        ~F.coalesce(kind.isin("vin", "url"), F.lit(False)),
        F.concat(F.lit("Unsupported input type: "), F.coalesce(kind, F.lit("None"))),
    )


def source_error(url: Column, html: Column) -> Column:
    """A request names exactly one of a URL and a page body."""
    has_url = F.coalesce(url != "", F.lit(False))
    has_html = F.coalesce(html != "", F.lit(False))
    return F.when(~has_url & ~has_html, F.lit("Must provide either url or html")).when(
        has_url & has_html, F.lit("Cannot provide both url and html")
    )


def page_valid(html: Column) -> Column:
    low = F.lower(html)
    bad = F.lit(False)
    for phrase in ERROR_PHRASES:
        bad = bad | F.contains(low, F.lit(phrase))
    good = F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body"))
    return F.coalesce((html != "") & ~bad & good, F.lit(False))


def has_vehicle_data(html: Column) -> Column:
    return F.coalesce(F.lower(html).rlike("|".join(VEHICLE_WORDS)), F.lit(False))


def domain_marks(html: Column) -> Column:
    """Known sites a page body mentions."""
    low = F.lower(html)
    found = []
    for name, marks in DOMAIN_MARKS.items():
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(low, F.lit(mark))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def _origin(base: Column) -> Column:
    return F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def root_relative(src: Column, base: Column) -> Column:
    """Generic rule: only //host/... and /path are made absolute."""
    return let(src, lambda s: _root_relative(s, base))


def _root_relative(src: Column, base: Column) -> Column:
    return (
        F.when(F.startswith(src, F.lit("//")), F.concat(F.lit("https:"), src))
        .when(F.startswith(src, F.lit("/")), F.concat(_origin(base), _no_dots(src)))
        .otherwise(src)
    )


def _no_dots(path: Column) -> Column:
    """Resolve . and .. segments, leaving the query alone."""
    return let(path, lambda p: F.when(F.contains(p, F.lit("/.")), _solve_dots(p)).otherwise(p))


def _solve_dots(path: Column) -> Column:
    cut = F.regexp_extract(path, r"^([^?#]*)", 1)
    tail = F.regexp_extract(path, r"^[^?#]*(.*)$", 1)

    def push(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        return F.when(s == "..", up).when(s == ".", acc).otherwise(F.array_append(acc, s))

    parts = F.split(F.regexp_replace(cut, r"/\.{1,2}$", "$0/"), "/")
    solved = F.aggregate(parts, F.array().cast("array<string>"), push)
    return F.when(~F.contains(cut, F.lit("/.")), path).otherwise(
        F.concat(F.array_join(solved, "/"), tail)
    )


def absolute(src: Column, base: Column) -> Column:
    """Full relative-reference resolution."""
    return let(src, lambda s: _absolute(s, base))


def _absolute(src: Column, base: Column) -> Column:
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_replace(
        F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*(/.*)?$", 1), r"[^/]*$", ""
    )
    return (
        F.when(src == "", base)
        .when(src.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), src)
        .when(F.startswith(src, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/]+:)", 1), src))
        .when(F.startswith(src, F.lit("/")), F.concat(_origin(base), _no_dots(src)))
        .when(F.startswith(src, F.lit("?")), F.concat(plain, src))
        .when(F.startswith(src, F.lit("#")), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), src))
        .otherwise(
            F.concat(
                _origin(base),
                _no_dots(F.concat(F.coalesce(blank_to_null(folder), F.lit("/")), src)),
            )
        )
    )


def vins_in(text: Column) -> Column:
    """Distinct VIN-shaped words of a text, upper case."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b({VIN_CLASS}{{17}})\b"), F.lit(1))
    return let(found, lambda v: F.array_distinct(F.transform(v, F.upper)))
