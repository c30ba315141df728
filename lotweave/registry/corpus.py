"""Listing corpora derived by Spark from the given tables (one listing per ``part`` row).

``LISTINGS`` is plain SQL that means the same in Spark and in ANSI engines, so the truth the pages
are written from is also the truth a check can select directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.session import spread

# Twenty listings per dealer, in order: every supplier is one, and there are twenty parts per supplier.
_FIELDS = """p_partkey AS listing_id,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE substr(upper(md5(cast(p_partkey AS string))), 1, 17) END AS vin,
  cast(1985 + p_size AS int) AS year,
  replace(p_brand, '#', '') AS make,
  p_name AS model,
  p_type AS body_style,
  split_part(p_name, ' ', 1) AS color,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE cast(1500 + (p_partkey * 7919) % 60000 AS int) END AS price,
  cast((p_partkey * 104729) % 160000 AS int) AS mileage,
  s_name AS dealer_name,
  n_name AS location,
  concat('(555) ', lpad(cast(100 + p_partkey % 900 AS string), 3, '0'), '-',
         lpad(cast(p_partkey % 10000 AS string), 4, '0')) AS dealer_phone,
  CASE p_partkey % 4 WHEN 0 THEN 'www.cars.com' WHEN 1 THEN 'carfax.com' WHEN 2 THEN 'm.cars.com'
    ELSE concat('dealer', cast(p_partkey % 10 AS string), '.example.com') END AS host,
  CASE p_partkey % 3 WHEN 0 THEN 'No accident reported' WHEN 1 THEN '1 accident reported' END AS accident_text,
  p_partkey % 17 = 0 AS is_error_page
"""
_JOINED = """FROM {part} JOIN (
  SELECT s_suppkey, s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
  ) d ON s_suppkey = cast(floor(p_partkey / 20) AS bigint)
"""
# The same join with its keys named: a supplier is a dealer's site, as in the configs.
_MET = """FROM (SELECT *, p_partkey AS listing_id, cast(floor(p_partkey / 20) AS bigint) AS site_id FROM {part}) p JOIN (
  SELECT s_suppkey AS site_id, s_name, n_name FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
  ) d ON p.site_id = d.site_id
"""
LISTINGS = f"\nSELECT {_FIELDS}{_JOINED}"
LISTINGS_SQL = LISTINGS.format(part="part", supplier="supplier", nation="nation")
URL = "concat('https://', host, '/vehicledetail/', cast(listing_id AS string), '/')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # both sides grow with the corpus, and a table's packed files say little about its rows: neither side is broadcast
    tables = {name: table(spark, sf_dir, name) for name in ("part", "supplier", "nation")}
    joined = spark.sql(f"SELECT /*+ MERGE(d) */ listing_id, p_name, p_brand, p_type, p_size, s_name, n_name {_MET}", **tables)
    # the join's slim rows may all come out of one task: they are dealt before anything is computed from them
    fields = _FIELDS.replace("p_partkey AS listing_id", "listing_id").replace("p_partkey", "listing_id")
    return spark.sql(f"SELECT {fields}FROM {{joined}}", joined=spread(joined, "listing_id"))


def _tag(markup: str, value: str) -> str:
    """SQL for an element whose text sits on a line of its own."""
    name = markup.split(" ", 1)[0]
    return f"'<{markup}>\\n', {value}, '\\n</{name}>'"


_TITLE = "concat_ws(' ', cast(year AS string), make, model)"
_COST = "concat('$', format_number(price, 0))"
_MILES = "format_number(mileage, 0)"
_HEAD = f"concat('<!DOCTYPE html><html><head>', {_tag('title', _TITLE)}, '<style>p {{}}</style></head><body>')"
_FEATURES = "'<li>\\nKeyless Entry\\n</li><li>\\nHeated Seats\\n</li><li>\\nRear Camera\\n</li>'"
_IMAGES = (
    "concat('<img src=\"/img/', listing_id, '-1.jpg\" width=\"640\" height=\"480\"><img src=\"//cdn.example.com/', "
    "listing_id, '-2.jpg\"><img src=\"/icons/logo.png\" width=\"32\" height=\"32\">')"
)
_HISTORY = f"coalesce(concat({_tag('p class=\"history\"', 'accident_text')}), '')"
_NOTE = _tag('p class="note"', "'404 Not Found'")
_ERROR = f"if(is_error_page, concat({_NOTE}), '')"
_TAIL = f"concat({_HISTORY}, {_ERROR}, '</body></html>')"

_EXTRAS = [
    "dealer-address-note", "fuel-type", "transmission", "drivetrain", "engine-info", "carfax-link",
    "certified-badge", "warranty-info", "listing-date", "days-on-lot", "stock-number",
    "vehicle-description", "vehicle-info__trim",
]

_LAYOUT_A = f"""concat({_HEAD}, {_tag('h1 class="listing-title"', _TITLE)},
  '<div class="vehicle-info">', {_tag('span class="vehicle-info__year"', 'year')},
  {_tag('span class="vehicle-info__make"', 'make')}, {_tag('span class="vehicle-info__model"', 'model')},
  {_tag('span class="vehicle-info__mileage"', 'mileage')}, {_tag('span class="vehicle-info__color"', 'color')}, '</div>',
  coalesce(concat('<div class="price-section">', {_tag('span class="primary-price"', _COST)}, '</div>'), ''),
  '<div class="vehicle-details"><dl>', {_tag('dt', "'Exterior color:'")}, {_tag('dd', 'color')},
  {_tag('dt', "'Body style:'")}, {_tag('dd', 'body_style')}, '</dl></div>',
  {_tag('p data-qa="mileage-value"', f"concat({_MILES}, ' mi.')")},
  {_tag('p class="dealer-name" data-qa="dealer-name"', 'dealer_name')},
  {_tag('a class="dealer-phone" data-qa="dealer-phone" href="tel:555"', 'dealer_phone')},
  {_tag('p class="dealer-address"', "concat(listing_id % 100, ' Main St, Springfield, TX')")},
  coalesce(concat({_tag('span data-qa="vin-value"', 'vin')}), ''),
  '<ul class="vehicle-features">', {_FEATURES}, '</ul><div class="vehicle-photos">', {_IMAGES}, '</div>',
  if(listing_id % 8 = 0, concat({", ".join(_tag(f'i class="{c}"', "'noted'") for c in _EXTRAS)}), ''),
  {_TAIL})"""

_LAYOUT_B = f"""concat({_HEAD}, {_tag('h1', _TITLE)}, '<div class="facts">',
  {_tag('span class="vehicle-year"', 'year')}, {_tag('span class="vehicle-make"', 'make')},
  {_tag('span class="vehicle-model"', 'model')}, '</div><div class="dealer-info">', {_tag('h3', 'dealer_name')},
  '</div><div class="dealer-phone">', {_tag('a href="tel:555"', 'dealer_phone')}, '</div>',
  coalesce(concat('<p>\\nVIN:\\n', {_tag('span data-test="vin-value"', 'vin')}, '</p>'), ''),
  coalesce(concat('<div class="price-display">', {_tag('b', "'Price:'")}, {_tag('span', _COST)}, '</div>'), ''),
  if(listing_id % 8 = 1, concat({_tag('span class="mileage-value"', 'mileage')}, {_tag('span', "'miles'")}),
     concat({_tag('span class="mileage-value"', f"concat({_MILES}, ' miles')")})),
  '<ul class="features-list">', {_FEATURES}, '</ul><div class="photo-gallery">', {_IMAGES}, '</div>', {_TAIL})"""

_LAYOUT_C = f"""concat({_HEAD}, {_tag('h1', _TITLE)}, '<div class="facts">',
  {_tag('span class="vehicle-year"', 'year')}, {_tag('span class="vehicle-make"', 'make')},
  {_tag('span class="vehicle-model"', 'model')}, {_tag('span class="color"', 'color')}, '</div>',
  {_tag('p class="dealer-name"', 'dealer_name')}, {_tag('p class="dealer-phone"', 'dealer_phone')},
  coalesce(concat('<p>\\nVIN:\\n', {_tag('span class="vin"', 'vin')}, '</p>'), ''),
  coalesce(concat('<p>\\nPrice:\\n', {_tag('span class="price"', _COST)}, '</p>'), ''),
  {_tag('span class="mileage"', 'mileage')}, {_tag('span', "'miles'")},
  '<div class="features"><ul>', {_FEATURES}, '</ul></div><div class="vehicle-photos">', {_IMAGES}, '</div>', {_TAIL})"""

_LAYOUT_D = f"""concat({_HEAD}, '<nav>', {_tag('a href="/"', "'All our offers'")}, '</nav>', {_tag('h1', _TITLE)},
  {_tag('p class="dealer"', 'dealer_name')}, {_tag('p', "concat('Call ', dealer_phone)")},
  coalesce(concat({_tag('p', "concat('VIN: ', vin)")}), ''),
  coalesce(concat({_tag('p', f"concat('Price: ', {_COST})")}), ''),
  {_tag('p', f"concat({_MILES}, ' miles')")}, '<ul>', {_FEATURES}, '</ul>', {_IMAGES}, {_TAIL})"""


_COST_SQL, _MILES_SQL, _TITLE_SQL = "'$' || format('{:,}', price)", "format('{:,}', mileage)", "year || ' ' || make || ' ' || model"
_LIST = ["'Keyless Entry'", "'Heated Seats'", "'Rear Camera'"]
_BODY = "[document] > html > body > "


def _layouts() -> tuple[list[list[tuple[str, str]]], list[list[tuple[str, str]]]]:
    """What is on each layout's page, in order, as SQL over a listing; null is not there.

    Strings as (text, selector of their element), and elements with a class as (class, text).
    """
    title = (_TITLE_SQL, "[document] > html > head > title")
    facts = ["cast(year AS varchar)", "make", "model"]
    plain, phone, address = "cast(mileage AS varchar)", "dealer_phone", "(listing_id % 100) || ' Main St, Springfield, TX'"
    error = "CASE WHEN is_error_page THEN '404 Not Found' END"
    tail = [("accident_text", ".history"), (error, ".note")]
    late = [("history", "accident_text"), ("note", error)]
    joined = " || ".join(_LIST)
    extras = [(c, "CASE WHEN listing_id % 8 = 0 THEN 'noted' END") for c in _EXTRAS]
    labels = ["CASE WHEN vin IS NOT NULL THEN 'VIN:' END", "CASE WHEN price IS NOT NULL THEN 'Price:' END"]
    b_miles = f"CASE WHEN listing_id % 8 = 1 THEN {plain} ELSE {_MILES_SQL} || ' miles' END"

    def items(above: str) -> list[tuple[str, str]]:
        return [(text, f"{above} > li") for text in _LIST]

    a_facts = [*zip(("year", "make", "model", "mileage", "color"), (*facts, plain, "color"))]
    named = [*zip(("year", "make", "model"), facts)]
    details = "body > div.vehicle-details > dl > "
    strings = [
        [title, (_TITLE_SQL, ".listing-title"), *[(x, f".vehicle-info__{n}") for n, x in a_facts], (_COST_SQL, ".primary-price"),
         ("'Exterior color:'", details + "dt"), ("color", details + "dd"), ("'Body style:'", details + "dt"), ("body_style", details + "dd"),
         (f"{_MILES_SQL} || ' mi.'", _BODY + "p"), ("dealer_name", ".dealer-name"), (phone, ".dealer-phone"), (address, ".dealer-address"),
         ("vin", _BODY + "span"), *items("html > body > ul.vehicle-features"), *[(x, f".{c}") for c, x in extras], *tail],
        [title, (_TITLE_SQL, _BODY + "h1"), *[(x, f".vehicle-{n}") for n, x in named], ("dealer_name", "html > body > div.dealer-info > h3"),
         (phone, "html > body > div.dealer-phone > a"), (labels[0], _BODY + "p"), ("vin", "html > body > p > span"),
         (labels[1], "html > body > div.price-display > b"), (_COST_SQL, "html > body > div.price-display > span"),
         (b_miles, ".mileage-value"), ("CASE WHEN listing_id % 8 = 1 THEN 'miles' END", _BODY + "span"), *items("html > body > ul.features-list"), *tail],
        [title, (_TITLE_SQL, _BODY + "h1"), *[(x, f".vehicle-{n}") for n, x in named], ("color", ".color"), ("dealer_name", ".dealer-name"),
         (phone, ".dealer-phone"), (labels[0], _BODY + "p"), ("vin", ".vin"), (labels[1], _BODY + "p"), (_COST_SQL, ".price"), (plain, ".mileage"),
         ("'miles'", _BODY + "span"), *items("body > div.features > ul"), *tail],
        [title, ("'All our offers'", "html > body > nav > a"), (_TITLE_SQL, _BODY + "h1"), ("dealer_name", ".dealer"), (f"'Call ' || {phone}", _BODY + "p"),
         ("'VIN: ' || vin", _BODY + "p"), (f"'Price: ' || {_COST_SQL}", _BODY + "p"), (f"{_MILES_SQL} || ' miles'", _BODY + "p"), *items("html > body > ul"), *tail],
    ]
    marks = [
        [("listing-title", _TITLE_SQL), ("vehicle-info", " || ".join(x for _, x in a_facts)), *[(f"vehicle-info__{n}", x) for n, x in a_facts],
         ("price-section", _COST_SQL), ("primary-price", _COST_SQL), ("vehicle-details", "'Exterior color:' || color || 'Body style:' || body_style"),
         ("dealer-name", "dealer_name"), ("dealer-phone", phone), ("dealer-address", address), ("vehicle-features", joined), ("vehicle-photos", "''"), *extras, *late],
        [("facts", " || ".join(facts)), *[(f"vehicle-{n}", x) for n, x in named], ("dealer-info", "dealer_name"), ("dealer-phone", phone),
         ("price-display", f"'Price:' || {_COST_SQL}"), ("mileage-value", b_miles), ("features-list", joined), ("photo-gallery", "''"), *late],
        [("facts", " || ".join([*facts, "color"])), *[(f"vehicle-{n}", x) for n, x in named], ("color", "color"), ("dealer-name", "dealer_name"),
         ("dealer-phone", phone), ("vin", "vin"), ("price", _COST_SQL), ("mileage", plain), ("features", joined), ("vehicle-photos", "''"), *late],
        [("dealer", "dealer_name"), *late],
    ]
    return strings, marks


_STRINGS, _MARKS = _layouts()


def _by_layout(rows: list[list[str]]) -> str:
    return "CASE listing_id % 4 " + " ".join(f"WHEN {k} THEN [{', '.join(x)}]" for k, x in enumerate(rows)) + " END"


def _rows_sql(rows: list[list[str]], *names: str) -> str:
    picked = ", ".join(f"x.{n} AS {n}" for n in names)
    listed = f"SELECT listing_id, {_by_layout(rows)} AS s FROM listings"
    return f"SELECT listing_id AS page_id, pos, {picked} FROM (SELECT listing_id, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM ({listed})) WHERE x.text IS NOT NULL"


#: Strings and marks of every page as rows (page_id, pos, text, selector) and (page_id, pos, cls, text).
STRINGS_SQL = _rows_sql([[f"{{'text': {t}, 'selector': '{at}'}}" for t, at in rows] for rows in _STRINGS], "text", "selector")
MARKS_SQL = _rows_sql([[f"{{'cls': '{c}', 'text': {t}}}" for c, t in rows] for rows in _MARKS], "cls", "text")


def lines_sql(keep: str, nav: bool) -> str:
    """SQL for a page's lines: the strings `x` that `keep` keeps, with or without those of its navigation."""
    shown = [[text for text, at in rows if nav or " nav " not in at] for rows in _STRINGS]
    return f"array_to_string(list_filter({_by_layout(shown)}, lambda x: x IS NOT NULL AND ({keep})), chr(10))"


def listing_pages(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(page_id, url, html) of all listings in four site layouts."""
    html = f"""CASE listing_id % 4 WHEN 0 THEN {_LAYOUT_A} WHEN 1 THEN {_LAYOUT_B}
      WHEN 2 THEN {_LAYOUT_C} ELSE {_LAYOUT_D} END"""
    return listings(spark, sf_dir).select(
        F.col("listing_id").alias("page_id"), F.expr(URL).alias("url"), F.expr(html).alias("html"), *keep
    )


def driver_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id")


SITE_OF_PAGE = "CASE page_id % 4 WHEN 0 THEN 'cars_com' WHEN 1 THEN 'carfax' WHEN 2 THEN 'default' ELSE 'unlisted' END"

REQUEST_VALUE = f"""CASE listing_id % 8
  WHEN 0 THEN vin WHEN 1 THEN {URL} WHEN 2 THEN lower(vin)
  WHEN 3 THEN concat('www.', host, '/x') WHEN 4 THEN substr(vin, 1, 16) WHEN 5 THEN vin || 'Z'
  WHEN 6 THEN '  ' ELSE concat('https://', host, '/gone/', cast(listing_id AS string)) END"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select(
        F.col("listing_id").alias("request_id"), F.expr(REQUEST_VALUE).alias("input_value")
    )


_RESPONSE = """concat(if(listing_id % 2 = 0, 'Here is the record:\\n', ''), '{"vin": "', coalesce(vin, ''),
  '", "make": "', make, '", "model": " ', model, ' ", "year": ', year + if(listing_id % 5 = 0, 1, 0),
  if(price IS NULL, ', "price": null', if(listing_id % 3 = 0, concat(', "price": "$', format_number(price, 0), '"'),
     concat(', "price": ', price))),
  ', "mileage": ', mileage, '.5, "color": "', if(listing_id % 4 = 0, '  ', color), '"',
  if(listing_id % 7 = 0, '', concat(', "dealer_name": "', dealer_name, '"')),
  ', "location": "', location, '", "accidents": ',
  CASE listing_id % 3 WHEN 0 THEN 'false' WHEN 1 THEN '"yes"' ELSE 'null' END,
  ', "features": [" Keyless Entry ", "", "Heated Seats"], "images": [], "owners": "n/a"}',
  if(listing_id % 2 = 0, '\\nDone.', ''))"""


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers a model gave per page, with the noise such answers carry."""
    return listings(spark, sf_dir).select(
        F.col("listing_id").alias("page_id"),
        F.expr("if(listing_id % 2 = 0, 'openai-gpt-4', 'ollama-llama2')").alias("model_used"),
        F.expr("cast(100 + listing_id % 50 AS int)").alias("tokens_used"),
        F.expr(f"if(listing_id % 19 = 0, 'Sorry, nothing {{found', {_RESPONSE})").alias("response"),
    )


# Cleaned answers, straight from the listing.
RESPONSE_TRUTH = """
SELECT listing_id AS page_id, listing_id % 19 <> 0 AS ok, vin, make, model,
  cast(year + CASE WHEN listing_id % 5 = 0 THEN 1 ELSE 0 END AS int) AS year, price, mileage,
  CASE WHEN listing_id % 4 = 0 THEN NULL ELSE color END AS color,
  CASE WHEN listing_id % 7 = 0 THEN NULL ELSE dealer_name END AS dealer_name, location,
  CASE listing_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS accidents
FROM listings
"""


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw hits of a VIN search, one to four per VIN, some with unusable links."""
    return (
        listings(spark, sf_dir)
        .where("vin IS NOT NULL")
        .select("listing_id", "vin", F.explode(F.expr("sequence(0L, listing_id % 4)")).alias("seq"))
        .select(
            "vin",
            F.expr("concat(CASE seq WHEN 0 THEN 'zeta' WHEN 1 THEN 'Beta' WHEN 2 THEN 'alpha' ELSE 'none' END, "
                   "' ', cast(listing_id AS string))").alias("title"),
            F.expr("CASE seq WHEN 0 THEN concat('https://www.cars.com/d/', cast(listing_id AS string)) "
                   "WHEN 1 THEN concat('https://example.org/', cast(listing_id AS string)) "
                   "WHEN 2 THEN concat('https://Autotrader.com/', cast(listing_id AS string)) "
                   "ELSE 'not a url' END").alias("href"),
            F.lit("snippet").alias("snippet"),
            "seq",
        )
    )


SEARCH_TRUTH = """
SELECT vin, listing_id, seq,
  CASE seq WHEN 0 THEN 'zeta' WHEN 1 THEN 'Beta' ELSE 'alpha' END || ' ' || listing_id AS title,
  CASE seq WHEN 0 THEN 'https://www.cars.com/d/' || listing_id WHEN 1 THEN 'https://example.org/' || listing_id
    ELSE 'https://Autotrader.com/' || listing_id END AS href,
  CASE seq WHEN 0 THEN 'cars.com' WHEN 1 THEN 'example.org' ELSE 'autotrader.com' END AS domain,
  seq <> 1 AS is_supported
FROM (SELECT vin, listing_id, unnest(range(0, listing_id % 4 + 1)) AS seq FROM listings WHERE vin IS NOT NULL)
WHERE seq < 3
"""


_CONFIG = """concat('{',
  if(s_suppkey % 4 = 1, '"_metadata": {"version": "1.2.0", "site": "s"}, ', ''),
  '"vin": "//span[@data-qa=\\'vin-value\\']/text()", ',
  if(s_suppkey % 6 = 0, '', '"goal": "Buy a car", '),
  '"price": "', if(s_suppkey % 5 = 0, '.amount', '.price'), '", ',
  if(s_suppkey % 3 = 0, concat('"year": {"selector": ".y", "type": "', if(s_suppkey % 9 = 0, 'regex', 'css'), '"}, '), ''),
  if(s_suppkey % 8 = 0, '"make": [".a", ".b"], ', ''),
  if(s_suppkey % 10 = 3, '"color": "", ', ''),
  if(s_suppkey % 14 = 2, '"model": {"type": "css"}, ', ''),
  '"trim": "', if(s_suppkey % 7 = 0, '//span[', '#trim > b'), '"',
  if(s_suppkey % 11 = 5, '', '}'))"""


def site_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping file per supplier site (site_id, config), some of them broken."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("site"), F.col("s_suppkey")).alias("site_id"), F.expr(_CONFIG).alias("config")
    )


# The same configs as rows (site, field, kind, rule, ordinal), straight from the supplier table.
CONFIG_RULES = """
SELECT k, 'site' || k AS site_id, field, kind, rule, row_number() OVER (PARTITION BY k ORDER BY pos) AS ordinal
FROM (
  SELECT s_suppkey AS k, 0 AS pos, '_metadata' AS field, 'meta' AS kind, '{"site":"s","version":"1.2.0"}' AS rule FROM supplier WHERE s_suppkey % 4 = 1
  UNION ALL SELECT s_suppkey, 1, 'vin', 'xpath', '//span[@data-qa=''vin-value'']/text()' FROM supplier
  UNION ALL SELECT s_suppkey, 2, 'goal', 'static', 'Buy a car' FROM supplier WHERE s_suppkey % 6 <> 0
  UNION ALL SELECT s_suppkey, 3, 'price', 'css', CASE WHEN s_suppkey % 5 = 0 THEN '.amount' ELSE '.price' END FROM supplier
  UNION ALL SELECT s_suppkey, 4, 'year', CASE WHEN s_suppkey % 9 = 0 THEN 'regex' ELSE 'css' END, '.y' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT s_suppkey, 5, 'make', 'list', '[".a",".b"]' FROM supplier WHERE s_suppkey % 8 = 0
  UNION ALL SELECT s_suppkey, 6, 'color', 'static', '' FROM supplier WHERE s_suppkey % 10 = 3
  UNION ALL SELECT s_suppkey, 7, 'model', 'css', NULL FROM supplier WHERE s_suppkey % 14 = 2
  UNION ALL SELECT s_suppkey, 8, 'trim', CASE WHEN s_suppkey % 7 = 0 THEN 'xpath' ELSE 'css' END,
    CASE WHEN s_suppkey % 7 = 0 THEN '//span[' ELSE '#trim > b' END FROM supplier)
WHERE k % 11 <> 5
"""
