"""Queries of the three extraction routes over the listing pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotweave.functions import record, values
from lotweave.operators.dom import with_dom
from lotweave.operators.selectors import let, page_text
from lotweave.plans import generic, mapping, model, pipeline, schemas, site
from lotweave.registry import corpus as C
from lotweave.registry.base import query, truth
from lotweave.registry.scalars import goal_sql
from lotweave.sources.rules import built_in_configs, rule_rows, rule_sets
from lotweave.sources.site_rules import SITE_RULES

_OK = "year <= 2030"
_TITLE = "year || ' ' || make || ' ' || model"
_FEATURES = "'Keyless Entry|Heated Seats|Rear Camera'"


def routed(spark, sf, parser: str):
    """Element arrays of the listing pages that take a route."""
    pages = pipeline.route(C.listing_pages(spark, sf), pipeline.parser_registry(spark))
    return with_dom(pages.where(F.col("parser") == parser).select("page_id", "url", "html"))


# --- site layout ---------------------------------------------------------------------------

_SITE = "FROM listings WHERE host = 'www.cars.com'"
_SITE_IMAGES = ("'https://www.cars.com/img/' || listing_id || '-1.jpg|https://cdn.example.com/' || listing_id || "
                "'-2.jpg|https://www.cars.com/icons/logo.png'")
_ADDRESS = "(listing_id % 100) || ' Main St, Springfield, TX'"


@query("site_extract", truth(f"""SELECT listing_id AS page_id, vin, CASE WHEN {_OK} THEN year END AS year,
  CASE WHEN {_OK} THEN make END AS make, CASE WHEN {_OK} THEN model END AS model, {_TITLE} AS listing_title, price, mileage,
  color, body_style, dealer_name, replace(dealer_phone, ' ', '') AS dealer_phone, {_ADDRESS} AS dealer_address,
  ' Springfield, TX' AS location, {_FEATURES} AS features, {_SITE_IMAGES} AS images,
  CASE listing_id % 3 WHEN 0 THEN false WHEN 1 THEN true END AS accidents, cast(0.9 AS double) AS confidence {_SITE}"""))
def site_extract(spark, sf):
    v = [F.col(f"vehicle.{f}").alias(f) for f in (
        "vin year make model listing_title price mileage color body_style dealer_name dealer_phone dealer_address location accidents".split())]
    return site.parse_site(routed(spark, sf, "site")).select(
        "page_id", *v, F.array_join("vehicle.features", "|").alias("features"),
        F.array_join("vehicle.images", "|").alias("images"), "confidence")


@query("cascade_price", truth(f"SELECT listing_id AS page_id, price {_SITE}"))
def cascade_price(spark, sf):
    return routed(spark, sf, "site").select("page_id", site.price().alias("price"))


@query("site_vin", truth(f"SELECT listing_id AS page_id, vin {_SITE}"))
def site_vin(spark, sf):
    return routed(spark, sf, "site").select("page_id", site.vin().alias("vin"))


@query("site_details", truth(f"SELECT listing_id AS page_id, vin, mileage, 'color=' || color || '|body_style=' || body_style AS details {_SITE}"))
def site_details(spark, sf):
    pairs = F.transform(site.details(), lambda p: F.concat_ws("=", p["field"], p["value"]))
    return routed(spark, sf, "site").select(
        "page_id", site.vin().alias("vin"), site.mileage().alias("mileage"), F.array_join(pairs, "|").alias("details"))


@query("kv_pairs", truth(f"""SELECT listing_id AS page_id, 'color' AS field, color AS value {_SITE}
  UNION ALL SELECT listing_id, 'body_style', body_style {_SITE}"""))
def kv_pairs(spark, sf):
    return routed(spark, sf, "site").select("page_id", F.explode(site.details()).alias("p")).select("page_id", "p.field", "p.value")


@query("site_dealer", truth(f"""SELECT listing_id AS page_id, dealer_name, replace(dealer_phone, ' ', '') AS dealer_phone,
  {_ADDRESS} AS dealer_address, ' Springfield, TX' AS location {_SITE}"""))
def site_dealer(spark, sf):
    return routed(spark, sf, "site").select("page_id", site.dealer().alias("d")).select("page_id", "d.*")


@query("site_features", truth(f"SELECT listing_id AS page_id, {_FEATURES} AS features {_SITE}"))
def site_features(spark, sf):
    return routed(spark, sf, "site").select("page_id", F.array_join(site.features(), "|").alias("features"))


@query("site_images", truth(f"SELECT listing_id AS page_id, {_SITE_IMAGES} AS images {_SITE}"))
def site_images(spark, sf):
    return routed(spark, sf, "site").select("page_id", F.array_join(site.images(F.col("url")), "|").alias("images"))


# --- generic route -------------------------------------------------------------------------

_GEN = "FROM listings WHERE host <> 'www.cars.com'"
_GEN_IMAGES = "'https://' || host || '/img/' || listing_id || '-1.jpg|https://cdn.example.com/' || listing_id || '-2.jpg'"
_POINTS = f"""(CASE WHEN vin IS NOT NULL THEN 40 ELSE 0 END + CASE WHEN price IS NOT NULL THEN 30 ELSE 0 END
  + CASE WHEN {_OK} THEN 30 ELSE 0 END + CASE WHEN mileage > 0 THEN 5 ELSE 0 END + 10)"""
_ENOUGH = f"(cast(vin IS NOT NULL AS int) + cast(price IS NOT NULL AS int) + cast({_OK} AS int)) >= 2"
_CONF = f"CASE WHEN {_ENOUGH} THEN least({_POINTS}, 100) ELSE 0 END / 100.0"
_CONF = f"cast({_CONF} AS double)"


@query("generic_extract", truth(f"""SELECT listing_id AS page_id, vin, price, nullif(mileage, 0) AS mileage,
  CASE WHEN {_OK} THEN year END AS year, CASE WHEN {_OK} THEN make END AS make, CASE WHEN {_OK} THEN model END AS model,
  CASE WHEN {_OK} THEN {_TITLE} END AS listing_title, dealer_phone, dealer_name, {_GEN_IMAGES} AS images,
  {_FEATURES} AS features, {_CONF} AS confidence, {_CONF} >= 0.7 AS success,
  CASE WHEN {_CONF} < 0.7 THEN 'Insufficient data for confident parsing' END AS error,
  {_ENOUGH} AS has_record {_GEN}"""))
def generic_extract(spark, sf):
    out = generic.parse_generic(routed(spark, sf, "generic"))
    return out.select(
        "page_id", *[F.col(f"found.{f}").alias(f) for f in generic.FIELDS if f not in ("images", "features")],
        F.array_join("found.images", "|").alias("images"), F.array_join("found.features", "|").alias("features"),
        "confidence", "success", "error", F.col("vehicle").isNotNull().alias("has_record"))


@query("generic_vin", truth(f"SELECT listing_id AS page_id, vin {_GEN}"))
def generic_vin(spark, sf):
    return routed(spark, sf, "generic").select("page_id", let(page_text(), values.text_vin).alias("vin"))


@query("generic_price", truth(f"SELECT listing_id AS page_id, price {_GEN}"))
def generic_price(spark, sf):
    return routed(spark, sf, "generic").select(
        "page_id", let(page_text(), lambda t: values.modal_price(values.text_prices(t))).alias("price"))


@query("generic_mileage", truth(f"SELECT listing_id AS page_id, mileage {_GEN}"))
def generic_mileage(spark, sf):
    return routed(spark, sf, "generic").select("page_id", let(page_text(), values.text_mileage).alias("mileage"))


@query("generic_title", truth(f"""SELECT listing_id AS page_id, CASE WHEN {_OK} THEN year END AS year, CASE WHEN {_OK} THEN make END AS make,
  CASE WHEN {_OK} THEN model END AS model, CASE WHEN {_OK} THEN {_TITLE} END AS listing_title {_GEN}"""))
def generic_title(spark, sf):
    return routed(spark, sf, "generic").select("page_id", generic.title().alias("t")).select("page_id", "t.*")


@query("generic_dealer", truth(f"SELECT listing_id AS page_id, dealer_name, dealer_phone {_GEN}"))
def generic_dealer(spark, sf):
    return routed(spark, sf, "generic").select(
        "page_id", generic.dealer_name().alias("dealer_name"), let(page_text(), values.text_phone).alias("dealer_phone"))


@query("generic_features", truth(f"SELECT listing_id AS page_id, {_FEATURES} AS features {_GEN}"))
def generic_features(spark, sf):
    return routed(spark, sf, "generic").select("page_id", F.array_join(generic.features(), "|").alias("features"))


@query("images", truth(f"SELECT listing_id AS page_id, {_GEN_IMAGES} AS images {_GEN}"))
def images(spark, sf):
    return routed(spark, sf, "generic").select("page_id", F.array_join(generic.images(F.col("url")), "|").alias("images"))


@query("generic_confidence", truth(f"""SELECT listing_id AS page_id, {_CONF} AS confidence, {_CONF} < 0.7 AS requires_model,
  {_ENOUGH} AS sufficient {_GEN}"""))
def generic_confidence(spark, sf):
    found = routed(spark, sf, "generic").select("page_id", generic.generic_fields().alias("f"))
    score = record.generic_confidence(F.col("f"))
    return found.select("page_id", score.alias("confidence"), record.needs_model(score).alias("requires_model"),
                        record.sufficient(F.col("f")).alias("sufficient"))


_LONG = r"len(x) > 5 AND NOT regexp_full_match(x, '\d+')"


@query("model_input", truth(f"SELECT listing_id AS page_id, {C.lines_sql(_LONG, nav=False)} AS lines FROM listings"))
def model_input(spark, sf):
    return with_dom(C.listing_pages(spark, sf)).select("page_id", generic.model_input().alias("lines"))


# --- declarative mappings ------------------------------------------------------------------


def ruled(spark, sf):
    dom = with_dom(C.listing_pages(spark, sf)).withColumn("site_id", F.expr(C.SITE_OF_PAGE))
    return mapping.with_rules(dom, rule_sets(rule_rows(built_in_configs(spark))))


_SITES = {
    "cars_com": ("listing_id % 4 = 0", "Buy a quality pre-owned vehicle from Cars.com"),
    "carfax": ("listing_id % 4 = 1", "Purchase a Carfax-verified vehicle with complete history"),
    "default": ("listing_id % 4 = 2", "Purchase a quality pre-owned vehicle"),
}
_NOTED = ("trim description fuel_type transmission drivetrain engine carfax_available certified warranty "
          "listing_date days_on_lot stock_number").split()


def _field_truth(preview: bool) -> str:
    """Rows (page_id, site_id, field, value, value_int, n_values) of what the rules find."""
    rows = []

    def add(site_id, field, value, number="NULL", n=1, when="true"):
        rows.append(f"SELECT listing_id AS page_id, '{site_id}' AS site_id, '{field}' AS field, {value} AS value, "
                    f"cast({number} AS int) AS value_int, cast({n} AS int) AS n_values FROM listings WHERE {_SITES[site_id][0]} AND {when}")

    for s, (_, goal) in _SITES.items():
        add(s, "vin", "vin", when="vin IS NOT NULL")
        add(s, "goal", f"'{goal}'")
        add(s, "make", "make")
        add(s, "model", "model")
        add(s, "year", "cast(year AS varchar)", "year" if preview else "NULL")
        add(s, "price", "cast(price AS varchar)", "price", when="price IS NOT NULL")
        plain = s != "carfax"
        text = "cast(mileage AS varchar)" if plain else "CASE WHEN listing_id % 8 = 1 THEN cast(mileage AS varchar) ELSE format('{:,}', mileage) || ' miles' END"
        add(s, "mileage", "cast(mileage AS varchar)" if preview else text, "mileage" if preview else "NULL")
        if plain:
            add(s, "color", "color")
        add(s, "dealer.name", "dealer_name")
        add(s, "dealer.phone", "'tel:555'" if preview and s != "default" else "dealer_phone")
        if preview:
            add(s, "features", "'Keyless Entry'")
            add(s, "images", "'/img/' || listing_id || '-1.jpg'")
        else:
            add(s, "features", "NULL", n=3)
            add(s, "images", "NULL", n=3)
    add("cars_com", "dealer_address", _ADDRESS)
    for f in _NOTED:
        add("cars_com", f, "'noted'", when="listing_id % 8 = 0")
    return " UNION ALL ".join(rows)


FIELDS_SQL = _field_truth(False)
PREVIEW_SQL = _field_truth(True)
_PAGES = f"SELECT listing_id AS page_id, *, {C.SITE_OF_PAGE.replace('page_id', 'listing_id')} AS site_id FROM listings"


@query("map_fields", truth("SELECT page_id, site_id, field, value, value_int, n_values FROM f", f=FIELDS_SQL))
def map_fields(spark, sf):
    return mapping.field_values(mapping.map_fields(ruled(spark, sf))).drop("values")


_SCORES = """SELECT p.page_id, p.site_id, cast(coalesce(n, 0) AS int) AS fields_mapped,
  cast(CASE p.site_id WHEN 'unlisted' THEN 0 WHEN 'default' THEN 14 ELSE 26 END AS int) AS fields_total
  FROM pages_ p LEFT JOIN (SELECT page_id, count(*) AS n FROM f GROUP BY page_id) c ON p.page_id = c.page_id"""
_SCORED = """SELECT *, CASE WHEN fields_total > 0 THEN cast(fields_mapped AS double) / fields_total ELSE 0.0 END AS confidence FROM counts"""


@query("map_confidence", truth("""SELECT page_id, site_id, fields_mapped, fields_total, confidence, fields_mapped > 0 AS success,
  confidence < 0.7 OR fields_mapped < 3 AS fallback_needed,
  CASE WHEN site_id = 'unlisted' THEN 'No mapping found for site: unlisted' END AS error FROM scored""",
    f=FIELDS_SQL, pages_=_PAGES, counts=_SCORES, scored=_SCORED))
def map_confidence(spark, sf):
    return mapping.map_fields(ruled(spark, sf)).select(
        "page_id", "site_id", "fields_mapped", "fields_total", "confidence", "success", "fallback_needed", "error")


_VALID = "listing_id % 8 <> 5"


def _if(cond: str, col: str, name: str | None = None) -> str:
    return f"CASE WHEN {cond} THEN {col} END AS {name or col}"


@query("map_vehicle", truth(f"""SELECT listing_id AS page_id, {_VALID} AS record_valid, {_if(_VALID, 'vin')},
  {_if(_VALID + ' AND ' + _OK, 'year')}, {_if(_VALID, 'make')}, {_if(_VALID, 'model')}, {_if(_VALID, 'price')}, {_if(_VALID, 'mileage')},
  {_if(_VALID + ' AND listing_id % 4 <> 1', 'color')}, {_if(_VALID, 'dealer_name')}, {_if(_VALID, 'dealer_phone')},
  {_if(_VALID, _FEATURES, 'features')}, {_if(_VALID, "'||'", 'images')} FROM listings WHERE listing_id % 4 < 3
  UNION ALL SELECT listing_id, {', '.join(['NULL'] * 12)} FROM listings WHERE listing_id % 4 = 3"""))
def map_vehicle(spark, sf):
    v = mapping.map_vehicles(mapping.map_fields(ruled(spark, sf)))
    cols = "vin year make model price mileage color dealer_name dealer_phone".split()
    return v.select("page_id", "record_valid", *[F.col(f"vehicle.{c}").alias(c) for c in cols],
                    F.array_join("vehicle.features", "|").alias("features"), F.array_join("vehicle.images", "|").alias("images"))


@query("nested_fields", truth("""SELECT listing_id AS page_id, 'dealer' AS head, dealer_name AS name, dealer_phone AS phone
  FROM listings WHERE listing_id % 4 < 3"""))
def nested_fields(spark, sf):
    m = mapping.map_fields(ruled(spark, sf)).select("page_id", F.explode(mapping.nested(F.col("fields"))).alias("head", "inner"))
    return m.select("page_id", "head", F.col("inner")["name"].alias("name"), F.col("inner")["phone"].alias("phone"))


_ANSWER_POINTS = """cast(least((CASE WHEN vin IS NOT NULL THEN 15 ELSE 0 END + 45 + CASE WHEN price IS NOT NULL THEN 15 ELSE 0 END
  + CASE WHEN mileage > 0 THEN 10 ELSE 0 END + CASE WHEN listing_id % 7 = 0 THEN 0 ELSE 10 END + 10
  + CASE WHEN listing_id % 4 = 0 THEN 0 ELSE 5 END + 5), 100) / 100.0 AS double)"""
_MERGED = f"""SELECT l.*, s.confidence AS map_conf, s.fields_mapped, (s.confidence < 0.7 OR s.fields_mapped < 3) AND l.listing_id % 19 <> 0 AS ai,
  {_ANSWER_POINTS} AS ai_conf FROM listings l JOIN scored s ON l.listing_id = s.page_id"""
_MERGED_YEAR = "(year + CASE WHEN ai AND listing_id % 5 = 0 THEN 1 ELSE 0 END)"
_MERGED_OK = f"(ai OR ({_VALID} AND listing_id % 4 <> 3))"
_CTES = dict(f=FIELDS_SQL, pages_=_PAGES, counts=_SCORES, scored=_SCORED, m=_MERGED)


@query("map_goal", truth(f"""SELECT listing_id AS page_id, ai AS model_used, CASE WHEN ai THEN greatest(map_conf, ai_conf) ELSE map_conf END AS confidence,
  CASE WHEN {_MERGED_OK} THEN {goal_sql(f'(CASE WHEN {_MERGED_YEAR} <= 2030 THEN {_MERGED_YEAR} END)', 'false')} END AS goal,
  CASE WHEN {_MERGED_OK} AND (listing_id % 4 <> 3 OR listing_id % 7 <> 0) THEN dealer_name END AS dealer FROM m""", **_CTES))
def map_goal(spark, sf):
    mapped = mapping.map_fields(ruled(spark, sf))
    merged = model.merge(mapped, model.parse_answers(C.model_responses(spark, sf)))
    done = mapping.map_vehicles(merged).withColumn("doc", record.goal_json(F.col("vehicle")))
    return done.select("page_id", "model_used", "confidence", F.get_json_object("doc", "$.goal").alias("goal"),
                       F.get_json_object("doc", "$.dealer.name").alias("dealer"))


@query("merge_override", truth("""SELECT listing_id AS page_id, field, CASE field
    WHEN 'year' THEN cast(year + CASE WHEN ai AND listing_id % 5 = 0 THEN 1 ELSE 0 END AS varchar)
    WHEN 'mileage' THEN CASE WHEN NOT ai AND listing_id % 8 = 5 THEN format('{:,}', mileage) || ' miles' ELSE cast(mileage AS varchar) END
    ELSE make END AS value
  FROM m, (SELECT unnest(['year', 'mileage', 'make']) AS field) WHERE ai OR listing_id % 4 <> 3""", **_CTES))
def merge_override(spark, sf):
    merged = model.merge(mapping.map_fields(ruled(spark, sf)), model.parse_answers(C.model_responses(spark, sf)))
    picked = F.array(*[F.struct(F.lit(f).alias("field"), mapping.pick(F.col("fields"), f)["value"].alias("value")) for f in ("year", "mileage", "make")])
    return merged.select("page_id", F.explode(picked).alias("p")).select("page_id", "p.*").where("value IS NOT NULL")


_RULED = "SELECT * FROM (VALUES " + ", ".join(
    f"('{site}', '{field}', '{'XPath' if rule.startswith('/') else 'selector'}')"
    for site, rules in SITE_RULES.items() for field, rule in rules.items() if isinstance(rule, str)
) + ") AS t(site_id, field, kind)"


@query("preview_fields", truth("""SELECT p.page_id, p.site_id, r.field, f.field IS NOT NULL AS success, f.value, f.value_int,
  CASE WHEN f.field IS NULL THEN 'No elements found with ' || r.kind END AS error
  FROM pages_ p JOIN r ON p.site_id = r.site_id LEFT JOIN f ON f.page_id = p.page_id AND f.field = r.field""", f=PREVIEW_SQL, pages_=_PAGES, r=_RULED))
def preview_fields(spark, sf):
    return mapping.preview_rows(mapping.preview(ruled(spark, sf))).select(
        "page_id", "site_id", "field", "success", "value", "value_int", "error")


@query("preview_documents", truth("""SELECT p.page_id, p.site_id, coalesce(n, 0) > 0 AS success, coalesce(n, 0) AS found, vin, make, year, price, dealer, cast(NULL AS varchar) AS goal
  FROM (SELECT page_id, site_id FROM pages_) p LEFT JOIN (SELECT page_id, count(DISTINCT split_part(field, '.', 1)) AS n, max(CASE WHEN field = 'vin' THEN value END) AS vin,
    max(CASE WHEN field = 'make' THEN value END) AS make, max(CASE WHEN field = 'year' THEN value_int END) AS year, max(CASE WHEN field = 'price' THEN value_int END) AS price,
    max(CASE WHEN field = 'dealer.name' THEN value END) AS dealer FROM f GROUP BY page_id) c ON c.page_id = p.page_id""", f=PREVIEW_SQL, pages_=_PAGES))
def preview_documents(spark, sf):
    # a single feature is no list, so these sites' previews make no goal
    get = lambda path: F.get_json_object("extracted_data", path)
    return mapping.preview_documents(mapping.preview(ruled(spark, sf))).select(
        "page_id", "site_id", "success", F.size(F.json_object_keys("extracted_data")).cast("long").alias("found"), get("$.vin").alias("vin"), get("$.make").alias("make"),
        get("$.year").cast("int").alias("year"), get("$.price").cast("int").alias("price"), get("$.dealer.name").alias("dealer"), "goal")


_PREVIEW = """SELECT p.page_id, p.site_id, cast(n AS int) AS successful_fields,
  cast(CASE p.site_id WHEN 'default' THEN 13 ELSE 25 END AS int) AS total_fields
  FROM pages_ p JOIN (SELECT page_id, count(*) AS n FROM f GROUP BY page_id) c ON p.page_id = c.page_id"""


@query("preview_summary", truth("""SELECT page_id, site_id, successful_fields, total_fields,
  cast(successful_fields AS double) / total_fields AS confidence, true AS success,
  cast(total_fields - successful_fields AS int) AS n_errors FROM s
  UNION ALL SELECT listing_id, 'unlisted', 0, 0, 0.0::double, false, 1 FROM listings WHERE listing_id % 4 = 3""", f=PREVIEW_SQL, pages_=_PAGES, s=_PREVIEW))
def preview_summary(spark, sf):
    return mapping.preview(ruled(spark, sf)).select(
        "page_id", "site_id", "successful_fields", "total_fields", "confidence", "success", F.size("errors").alias("n_errors"))


_TESTS = f"""SELECT p.*, CASE WHEN listing_id % 5 = 0 THEN 'https://' || host || '/gone/' || listing_id ELSE {C.URL} END AS test_url, listing_id % 5 <> 0 AS there
  FROM pages_ p"""


def schema_results(spark, sf):
    url = F.expr(f"CASE WHEN listing_id % 5 = 0 THEN concat('https://', host, '/gone/', cast(listing_id AS string)) ELSE {C.URL} END")
    site_id = F.expr(C.SITE_OF_PAGE.replace("page_id", "listing_id"))
    tests = C.listings(spark, sf).select(site_id.alias("site_id"), url.alias("url"))
    return schemas.test_schemas(tests, C.listing_pages(spark, sf), rule_sets(rule_rows(built_in_configs(spark))))


@query("schema_results", truth("""SELECT t.site_id, t.test_url AS url, there AND t.site_id <> 'unlisted' AS success,
  cast(CASE WHEN there AND t.site_id <> 'unlisted' THEN successful_fields ELSE 0 END AS int) AS fields_extracted,
  cast(CASE WHEN there AND t.site_id <> 'unlisted' THEN total_fields ELSE 0 END AS int) AS total_fields,
  CASE WHEN there AND t.site_id <> 'unlisted' THEN cast(successful_fields AS double) / total_fields ELSE 0.0 END AS confidence,
  cast(CASE WHEN there AND t.site_id <> 'unlisted' THEN total_fields - successful_fields END AS int) AS n_errors,
  CASE WHEN t.site_id = 'unlisted' THEN 'Schema not found: unlisted' WHEN NOT there THEN 'Failed to fetch: not in corpus' END AS error
  FROM t LEFT JOIN s ON s.page_id = t.page_id""", f=PREVIEW_SQL, pages_=_PAGES, s=_PREVIEW, t=_TESTS))
def schema_results_query(spark, sf):
    n = F.when(F.col("errors").isNotNull(), F.size("errors"))
    return schema_results(spark, sf).withColumn("n_errors", n).drop("errors")


@query("schema_test", truth("""SELECT site_id, cast(count(*) AS bigint) AS tests, cast(count(*) FILTER (WHERE there AND site_id <> 'unlisted') AS bigint) AS successes,
  avg(CASE WHEN there AND site_id <> 'unlisted' THEN 1.0::double ELSE 0.0::double END) AS success_rate FROM t GROUP BY site_id""", pages_=_PAGES, t=_TESTS))
def schema_test(spark, sf):
    return schemas.success_rates(schema_results(spark, sf))
