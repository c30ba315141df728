"""Text to value: prices, mileage, titles, phones and the cleaning rules of the mapping routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotweave.constants import MILEAGE_PATTERNS, PRICE_PATTERNS, VIN_CLASS, VIN_PATTERNS
from lotweave.operators.selectors import blank_to_null, let, only, strip


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def pick(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a regex, null instead of empty."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


# --- site layout ---------------------------------------------------------------------------


def site_price(text: Column) -> Column:
    digits = F.regexp_replace(text, r"[^0-9.]", "")
    return only(digits.try_cast("double").try_cast("int"), lambda n: n > 0)


def site_mileage(text: Column) -> Column:
    return to_int(pick(F.replace(text, F.lit(","), F.lit("")), r"([0-9]+)"))


def site_title(title: Column) -> Column:
    """Year, make and model from '2021 Make Model ...' with at least three words."""

    def read(words: Column) -> Column:
        year = F.when(F.size(words) >= 3, to_int(F.get(words, F.lit(0))))
        return let(
            only(year, lambda y: y.between(1900, 2030)),
            lambda y: F.struct(
                y.alias("year"),
                F.when(y.isNotNull(), F.get(words, F.lit(1))).alias("make"),
                F.when(y.isNotNull(), F.array_join(F.slice(words, 3, F.size(words)), " ")).alias("model"),
            ),
        )

    return let(F.split(strip(title), r"(?U)\s+"), read)


def site_phone(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9()\-]", "")


def site_location(text: Column) -> Column:
    return pick(text, r"(?U)([A-Za-z\s]+,\s*[A-Z]{2})")


def full_vin(text: Column) -> Column:
    return F.upper(only(text, lambda t: t.rlike(rf"(?i)^{VIN_CLASS}{{17}}$")))


def any_vin(text: Column) -> Column:
    return F.upper(pick(text, rf"(?i)({VIN_CLASS}{{17}})"))


# --- free text -----------------------------------------------------------------------------


def text_vin(text: Column) -> Column:
    """Labelled VIN first, then a bare 17-character word."""
    return F.upper(F.coalesce(*[pick(text, p) for p in VIN_PATTERNS]))


def text_prices(text: Column) -> Column:
    """All plausible prices, pattern by pattern, in text order."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in PRICE_PATTERNS])
    ints = F.transform(found, lambda p: to_int(F.replace(p, F.lit(","), F.lit(""))))
    return F.filter(ints, lambda p: p.between(1000, 200_000))


def modal_price(prices: Column) -> Column:
    """Most frequent price; the earliest wins a tie.  Equal prices are counted as runs of the sorted list."""

    def best(placed: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(placed) - 1),
            lambda k: (k == 0) | (F.get(placed, k)["price"] != F.get(placed, k - 1)["price"]),
        )

        def counted(begin: Column) -> Column:
            runs = F.transform(
                begin,
                lambda k, j: F.struct(
                    (F.coalesce(F.get(begin, j + 1), F.size(placed)) - k).alias("n"),
                    (-F.get(placed, k)["at"]).alias("at"),
                    F.get(placed, k)["price"].alias("price"),
                ),
            )
            return F.array_max(runs)["price"]

        return F.when(F.size(placed) > 0, let(starts, counted))

    return let(F.array_sort(F.transform(prices, lambda p, i: F.struct(p.alias("price"), i.alias("at")))), best)


def text_mileage(text: Column) -> Column:
    """First of three patterns whose first match is within range."""
    tries = []
    for p in MILEAGE_PATTERNS:
        n = to_int(F.replace(pick(text, p), F.lit(","), F.lit("")))
        tries.append(only(n, lambda m: m.between(0, 500_000)))
    return F.coalesce(*tries)


def text_title(title: Column) -> Column:
    """Year, make, model and title from a heading; null when it does not parse."""
    pattern = r"(?Ud)(\d{4})\s+(\w+)\s+(.+)"
    return let(
        to_int(pick(title, pattern, 1)),
        lambda year: F.when(
            year.between(1900, 2030),
            F.struct(
                year.alias("year"),
                F.regexp_extract(title, pattern, 2).alias("make"),
                strip(F.regexp_extract(title, pattern, 3)).alias("model"),
                title.alias("listing_title"),
            ),
        ),
    )


def text_phone(text: Column) -> Column:
    return pick(text, r"(?U)(\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4})")


# --- cleaning rules of the mapping routes ----------------------------------------------------


def plain(text: Column) -> Column:
    """Tags dropped, whitespace collapsed."""
    return strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"(?U)\s+", " "))


def _first_number(text: Column) -> Column:
    return to_int(pick(F.replace(text, F.lit(","), F.lit("")), r"([0-9]+)"))


def _numbered(text: Column, number: Column) -> Column:
    return let(
        number,
        lambda n: F.struct(F.coalesce(n.cast("string"), text).alias("value"), n.alias("number")),
    )


def clean_any(text: Column) -> Column:
    """Mapping rule: text naming a price becomes its first number.  struct(value, number)."""

    def read(t: Column) -> Column:
        number = F.when(
            F.contains(t, F.lit("$")) | F.contains(F.lower(t), F.lit("price")), _first_number(t)
        )
        return _numbered(t, number)

    return let(plain(text), read)


def clean_typed(text: Column, field: Column) -> Column:
    """Preview rule: price, mileage and year fields become numbers.  struct(value, number)."""

    def read(t: Column) -> Column:
        number = F.when(field.isin("price", "mileage"), _first_number(t)).when(
            field == "year", to_int(pick(t, r"((?:19|20)[0-9]{2})"))
        )
        return _numbered(t, number)

    return let(text, lambda raw: F.when(raw != "", let(plain(raw), read)))
