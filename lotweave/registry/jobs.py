"""Queries of whole jobs: configs, model answers, comparison, suggestions, search and requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lotweave.constants import FIELD_DICTIONARY, SEARCH_MAX_RESULTS
from lotweave.functions import record
from lotweave.operators.dom import with_dom
from lotweave.plans import compare, generic, mapping, model, pipeline, schemas, search, suggest
from lotweave.registry import corpus as C
from lotweave.registry.base import query, truth
from lotweave.registry.extraction import (
    _ANSWER_POINTS, _CONF, _ENOUGH, _OK, _PAGES, _PREVIEW, PREVIEW_SQL, ruled,
)
from lotweave.registry.scalars import _REQUESTS, goal_sql
from lotweave.sources import cases, pages as P
from lotweave.session import checkpoint_dir, written
from lotweave.sources.index import PageIndex, vin_pages as vin_pages_of
from lotweave.sources.rules import rule_rows

def indexed(spark, sf) -> PageIndex:
    """The listing pages' index, built for the query: lookups read it instead of bodies."""
    index = PageIndex(spark, f"{checkpoint_dir(spark).rstrip('/')}/page-index-{uuid.uuid4().hex}")
    index.add(C.listing_pages(spark, sf), 0)
    return index


# --- mapping configs -----------------------------------------------------------------------


@query("sites_list", f"SELECT DISTINCT site_id FROM ({C.CONFIG_RULES})")
def sites_list(spark, sf):
    return schemas.available_sites(C.site_configs(spark, sf))


@query("rules_load", f"SELECT site_id, field, cast(ordinal AS int) AS ordinal, CASE kind WHEN 'meta' THEN 'dict' ELSE CASE WHEN field IN ('year', 'model') THEN 'dict' ELSE kind END END AS kind FROM ({C.CONFIG_RULES})")
def rules_load(spark, sf):
    return rule_rows(C.site_configs(spark, sf)).select("site_id", "field", "ordinal", "kind")


@query("rules_classify", f"""SELECT site_id, field, CASE WHEN field = '_metadata' OR (field = 'model' AND kind = 'css') THEN 'css'
    WHEN field = 'year' OR kind = 'css' THEN 'css' WHEN kind = 'xpath' THEN 'xpath' END AS selector_type,
  CASE WHEN field = '_metadata' OR field = 'model' THEN '' WHEN kind IN ('static', 'list') THEN NULL ELSE rule END AS selector,
  CASE WHEN kind = 'static' THEN rule END AS static_value FROM ({C.CONFIG_RULES})""")
def rules_classify(spark, sf):
    return rule_rows(C.site_configs(spark, sf)).select(
        "site_id", "field", "selector_type", "selector", F.when(F.col("kind") == "static", F.col("rule")).alias("static_value"))


_VALIDATED = """SELECT 'site' || s_suppkey AS site_id, s_suppkey % 6 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 11 <> 5 AS valid,
  CASE WHEN s_suppkey % 11 = 5 THEN 'Mapping not found for site: site' || s_suppkey ELSE
    concat_ws('|', CASE WHEN s_suppkey % 6 = 0 THEN 'Missing required field: goal' END,
      CASE WHEN s_suppkey % 7 = 0 THEN 'Invalid selector for trim: //span[' END) END AS errors,
  CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 11 <> 5 THEN 'Price selector might not target price element' ELSE '' END AS warnings,
  CASE WHEN s_suppkey % 11 <> 5 THEN cast(3 + cast(s_suppkey % 4 = 1 AS int) + cast(s_suppkey % 6 <> 0 AS int) + cast(s_suppkey % 3 = 0 AS int)
    + cast(s_suppkey % 8 = 0 AS int) + cast(s_suppkey % 10 = 3 AS int) + cast(s_suppkey % 14 = 2 AS int) AS int) END AS fields_count FROM supplier"""


@query("rules_info", f"""SELECT v.site_id, i.fields, i.field_count, i.selectors, v.valid, v.errors, v.warnings FROM ({_VALIDATED}) v LEFT JOIN
  (SELECT site_id, string_agg(field, '|' ORDER BY ordinal) AS fields, cast(count(*) AS int) AS field_count,
    string_agg(field || '=' || CASE WHEN kind IN ('css', 'xpath', 'static') AND field NOT IN ('year', 'model', '_metadata') THEN rule ELSE '(object)' END, '|' ORDER BY ordinal)
      FILTER (WHERE field <> 'make') AS selectors
   FROM ({C.CONFIG_RULES}) GROUP BY site_id) i ON i.site_id = v.site_id""")
def rules_info(spark, sf):
    shown = F.transform(F.filter("selectors", lambda s: s["field"] != "make"), lambda s: F.concat(s["field"], F.lit("="), F.when(
        s["field"].isin("year", "model", "_metadata"), F.lit("(object)")).otherwise(s["rule"])))
    return schemas.mapping_info(C.site_configs(spark, sf)).select(
        "site_id", F.array_join("fields", "|").alias("fields"), "field_count", F.array_join(shown, "|").alias("selectors"),
        "validation.valid", F.array_join("validation.errors", "|").alias("errors"), F.array_join("validation.warnings", "|").alias("warnings"))


@query("schema_list", f"""SELECT site_id, max(CASE WHEN field = '_metadata' THEN '1.2.0' END) AS version, max(CASE WHEN field = '_metadata' THEN rule END) AS metadata,
  cast(count(*) FILTER (WHERE field <> '_metadata') AS int) AS field_count FROM ({C.CONFIG_RULES}) GROUP BY site_id""")
def schema_list(spark, sf):
    return schemas.list_schemas(C.site_configs(spark, sf))


@query("schema_get", """SELECT 'site' || (s_suppkey + 1) AS site_id,
  CASE WHEN s_suppkey = (SELECT max(s_suppkey) FROM supplier) THEN 'Schema not found: site' || (s_suppkey + 1) END AS error FROM supplier""")
def schema_get(spark, sf):
    wanted = C.table(spark, sf, "supplier").select(F.concat(F.lit("site"), F.col("s_suppkey") + 1).alias("site_id"))
    return schemas.get_schema(C.site_configs(spark, sf), wanted).select("site_id", "error")


@query("rules_validate", _VALIDATED)
def rules_validate(spark, sf):
    return schemas.validate_mapping(C.site_configs(spark, sf)).select(
        "site_id", "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"), "fields_count")


_CONFIG_OK = "s_suppkey % 6 <> 0 AND s_suppkey % 9 <> 0 AND s_suppkey % 8 <> 0 AND s_suppkey % 14 <> 2"
_CONFIG_ERRORS = """concat_ws('|', CASE WHEN s_suppkey % 6 = 0 THEN 'Missing required field: goal' END,
  CASE WHEN s_suppkey % 14 = 2 THEN 'Field ''model'' missing selector' END,
  CASE WHEN s_suppkey % 9 = 0 THEN 'Field ''year'' has invalid type: regex' END,
  CASE WHEN s_suppkey % 8 = 0 THEN 'Field ''make'' has invalid configuration type' END)"""


@query("config_validate", f"""SELECT 'site' || s_suppkey AS site_id, s_suppkey % 11 <> 5 AND {_CONFIG_OK} AS valid,
  CASE WHEN s_suppkey % 11 = 5 THEN 'unreadable' ELSE {_CONFIG_ERRORS} END AS errors,
  CASE WHEN s_suppkey % 10 = 3 AND s_suppkey % 11 <> 5 THEN 'Field ''color'' has empty selector' ELSE '' END AS warnings FROM supplier""")
def config_validate(spark, sf):
    return schemas.validate_config(C.site_configs(spark, sf)).select(
        "site_id", "valid", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings"))


def _metadata_keys():
    meta = F.to_json(F.try_variant_get(F.try_parse_json("config"), "$._metadata", "variant"))
    return F.array_join(F.array_sort(F.json_object_keys(meta)), "|").alias("metadata_keys")


@query("schema_create", f"""SELECT 'site' || s_suppkey AS site_id,
  CASE WHEN s_acctbal < 5000 THEN 'conflict' WHEN s_suppkey % 11 = 5 OR NOT ({_CONFIG_OK}) THEN 'invalid' ELSE 'created' END AS status,
  CASE WHEN s_acctbal < 5000 THEN 'Schema already exists: site' || s_suppkey WHEN s_suppkey % 11 = 5 THEN 'Invalid schema: unreadable'
    WHEN NOT ({_CONFIG_OK}) THEN 'Invalid schema: ' || replace({_CONFIG_ERRORS}, '|', ', ') END AS error,
  CASE WHEN s_acctbal >= 5000 AND s_suppkey % 11 <> 5 AND {_CONFIG_OK} THEN '1.0.0' END AS version,
  CASE WHEN s_acctbal >= 5000 AND s_suppkey % 11 <> 5 AND {_CONFIG_OK} THEN CASE WHEN s_suppkey % 4 = 1 THEN
    'created_at|created_by|site|site_id|version' ELSE 'created_at|created_by|site_id|version' END END AS metadata_keys FROM supplier""")
def schema_create(spark, sf):
    asked = C.site_configs(spark, sf)
    taken = C.table(spark, sf, "supplier").where("s_acctbal < 5000").select(F.concat(F.lit("site"), F.col("s_suppkey")).alias("site_id"))
    existing = asked.join(taken, "site_id", "left_semi")
    out = schemas.create_schemas(existing, asked)
    return out.select("site_id", "status", "error", F.get_json_object("config", "$._metadata.version").alias("version"), _metadata_keys())


@query("schema_requests", f"""WITH s AS (SELECT *, 'site' || s_suppkey AS site_id, s_acctbal < 5000 AS there, s_suppkey % 11 <> 5 AND {_CONFIG_OK} AS ok,
    CASE WHEN s_suppkey % 11 = 5 THEN 'Invalid schema: unreadable' ELSE 'Invalid schema: ' || replace({_CONFIG_ERRORS}, '|', ', ') END AS bad FROM supplier),
  r AS (SELECT *, cast(n AS bigint) AS request_no, CASE WHEN n = 2 THEN 'update' ELSE 'create' END AS op,
    CASE WHEN n = 2 THEN CASE WHEN NOT there AND NOT ok THEN 'missing' WHEN ok THEN 'updated' ELSE 'invalid' END
      WHEN there OR (n = 3 AND ok) THEN 'conflict' WHEN ok THEN 'created' ELSE 'invalid' END AS status FROM s, (SELECT unnest([1, 2, 3]) AS n))
  SELECT request_no, op, site_id, status, CASE status WHEN 'conflict' THEN 'Schema already exists: ' || site_id WHEN 'missing' THEN 'Schema not found: ' || site_id
    WHEN 'invalid' THEN bad END AS error FROM r""")
def schema_requests(spark, sf):
    configs = C.site_configs(spark, sf)
    taken = C.table(spark, sf, "supplier").where("s_acctbal < 5000").select(F.concat(F.lit("site"), F.col("s_suppkey")).alias("site_id"))
    asked = configs.select("site_id", "config", F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])).alias("request_no"))
    asked = asked.withColumn("op", F.when(F.col("request_no") == 2, "update").otherwise("create"))
    return schemas.schema_outcomes(configs.join(taken, "site_id", "left_semi"), asked)


@query("schema_update", f"""SELECT 'site' || s_suppkey AS site_id, s_acctbal < 5000 AND s_suppkey % 11 <> 5 AND {_CONFIG_OK} AS updated,
  CASE WHEN s_suppkey % 4 = 1 AND s_suppkey % 11 <> 5 THEN '1.2.0'
    WHEN s_acctbal < 5000 AND s_suppkey % 11 <> 5 AND {_CONFIG_OK} THEN '1.0.0' END AS version,
  CASE WHEN s_acctbal < 5000 AND s_suppkey % 11 <> 5 AND {_CONFIG_OK} THEN CASE WHEN s_suppkey % 4 = 1 THEN
      'site|site_id|updated_at|updated_by|version' ELSE 'site_id|updated_at|updated_by|version' END
    WHEN s_suppkey % 4 = 1 AND s_suppkey % 11 <> 5 THEN 'site|version' END AS metadata_keys FROM supplier""")
def schema_update(spark, sf):
    existing = C.site_configs(spark, sf)
    some = C.table(spark, sf, "supplier").where("s_acctbal < 5000").select(F.concat(F.lit("site"), F.col("s_suppkey")).alias("site_id"))
    asked = existing.join(some, "site_id", "left_semi")
    out = schemas.update_schemas(existing, asked)
    version = F.try_variant_get(F.try_parse_json("config"), "$._metadata.version", "string")
    return out.select("site_id", "updated", version.alias("version"), _metadata_keys())


# --- model answers -------------------------------------------------------------------------


def answers(spark, sf):
    return model.parse_answers(C.model_responses(spark, sf))


_ANSWER = f"{C.RESPONSE_TRUTH}"


@query("response_parse", truth("SELECT listing_id AS page_id, listing_id % 19 <> 0 AS parsed FROM listings"))
def response_parse(spark, sf):
    return C.model_responses(spark, sf).select("page_id", model.answer_json(F.col("response")).isNotNull().alias("parsed"))


@query("response_clean", truth("""SELECT page_id, vin, make, model, year, price, mileage, color, dealer_name, location, accidents,
  'Keyless Entry|Heated Seats' AS features, cast(NULL AS varchar) AS images, cast(NULL AS int) AS owners FROM a WHERE ok""", a=_ANSWER))
def response_clean(spark, sf):
    f = lambda n: F.col(f"fields.{n}").alias(n)
    return answers(spark, sf).where("success").select(
        "page_id", *[f(n) for n in "vin make model year price mileage color dealer_name location accidents owners".split()],
        F.array_join("fields.features", "|").alias("features"), F.array_join("fields.images", "|").alias("images"))


_COUNT = """cast(cast(vin IS NOT NULL AS int) + cast(price IS NOT NULL AS int) + cast(color IS NOT NULL AS int) + cast(dealer_name IS NOT NULL AS int)
  + cast(accidents IS NOT NULL AS int) + 6 AS int)"""


@query("model_only", truth(f"""SELECT page_id, ok AS success, CASE WHEN ok THEN {_COUNT} ELSE 0 END AS field_count,
  CASE WHEN NOT ok THEN 'Failed to parse AI response as valid JSON' END AS error FROM a""", a=_ANSWER))
def model_only(spark, sf):
    return answers(spark, sf).select("page_id", "success", "field_count", "error")


@query("model_confidence", truth(f"SELECT listing_id AS page_id, {_ANSWER_POINTS} AS confidence FROM listings WHERE listing_id % 19 <> 0"))
def model_confidence(spark, sf):
    return answers(spark, sf).where("success").select("page_id", "confidence")


_AI_YEAR = "(year + CASE WHEN listing_id % 5 = 0 THEN 1 ELSE 0 END)"


@query("goal_metadata", truth(f"""SELECT listing_id AS page_id,
  {goal_sql(f'(CASE WHEN {_AI_YEAR} <= 2030 THEN {_AI_YEAR} END)', 'listing_id % 3 = 0')} AS goal, 'ai' AS method,
  CASE WHEN listing_id % 2 = 0 THEN 'openai-gpt-4' ELSE 'ollama-llama2' END AS ai_model, {_ANSWER_POINTS} AS confidence,
  cast(100 + listing_id % 50 AS int) AS tokens FROM listings WHERE listing_id % 19 <> 0"""))
def goal_metadata(spark, sf):
    rows = answers(spark, sf).where("success").withColumn("v", model.vehicle_of(F.col("fields")))
    meta = model.goal_metadata(F.col("model_used"), F.col("confidence"), F.col("tokens_used"))
    doc = rows.select("page_id", record.goal_json(F.col("v"), meta).alias("doc"))
    get = lambda p: F.get_json_object("doc", p)
    return doc.select("page_id", get("$.goal").alias("goal"), get("$._metadata.extraction_method").alias("method"),
                      get("$._metadata.ai_model").alias("ai_model"), get("$._metadata.confidence").cast("double").alias("confidence"),
                      get("$._metadata.tokens_used").cast("int").alias("tokens"))


@query("prompt_build")
def prompt_build(spark, sf):
    dom = with_dom(C.listing_pages(spark, sf))
    found = dom.select("page_id", "url", "nodes", "texts", generic.generic_fields().alias("found"))
    return found.select("page_id", model.prompt(F.col("url"), generic.model_input(), F.to_json("found")).alias("prompt"))


@query("selector_prompt")
def selector_prompt(spark, sf):
    fields = [(d[0], d[1]) for d in FIELD_DICTIONARY]
    return C.listing_pages(spark, sf).select("page_id", model.selector_prompt(F.col("html"), fields).alias("prompt"))


# --- comparison ----------------------------------------------------------------------------

_BOTH = f"""SELECT coalesce(m.page_id, a.page_id) AS page_id, coalesce(m.field, a.field) AS field, m.value AS mv, a.value AS av, m.dotted FROM
  (SELECT page_id, field, value, false AS dotted FROM f WHERE field NOT LIKE 'dealer.%' AND page_id IN (SELECT page_id FROM ans WHERE ok)
   UNION ALL SELECT page_id, 'dealer', '{{''name'': ''' || max(CASE WHEN field = 'dealer.name' THEN value END) || ''', ''phone'': ''' || max(CASE WHEN field = 'dealer.phone' THEN value END) || '''}}', true
     FROM f WHERE field LIKE 'dealer.%' AND page_id IN (SELECT page_id FROM ans WHERE ok) GROUP BY page_id) m
  FULL OUTER JOIN (SELECT page_id, unnest(['vin', 'make', 'model', 'year', 'price', 'mileage', 'color', 'dealer_name', 'location', 'accidents', 'features']) AS field,
    unnest([vin, make, model, cast(year AS varchar), cast(price AS varchar), cast(mileage AS varchar), color, dealer_name, location,
      CASE WHEN accidents THEN 'True' WHEN NOT accidents THEN 'False' END, '[''Keyless Entry'', ''Heated Seats'']']) AS value
    FROM ans WHERE ok AND page_id % 4 < 3) a ON m.page_id = a.page_id AND m.field = a.field AND a.value IS NOT NULL
  WHERE coalesce(m.value, a.value) IS NOT NULL"""
_CMP = """SELECT *, CASE WHEN mv IS NULL THEN 0.0 WHEN av IS NULL THEN 0.5 WHEN mv = av THEN 1.0 WHEN field = 'features' THEN cast(26 AS double) / 46
    ELSE 1.0 - abs(cast(mv AS double) - cast(av AS double)) / greatest(cast(mv AS double), cast(av AS double)) END AS similarity FROM b"""
_KIND = """SELECT *, CASE WHEN mv IS NULL THEN 'missing' WHEN av IS NULL THEN 'extra' WHEN similarity >= 0.9 THEN 'match' ELSE 'different' END AS kind FROM c"""
_COMPARE = dict(f=PREVIEW_SQL, ans=_ANSWER, b=_BOTH, c=_CMP, k=_KIND)


def pairs(spark, sf):
    return compare.pair_up(mapping.preview(ruled(spark, sf)), answers(spark, sf))


def comparisons(spark, sf):
    return compare.compare_fields(pairs(spark, sf))


@query("compare_fields", truth("""SELECT page_id, field,
  cast(CASE field WHEN 'vin' THEN 0 WHEN 'price' THEN 1 WHEN 'year' THEN 2 WHEN 'make' THEN 3 WHEN 'model' THEN 4 WHEN 'mileage' THEN 5 ELSE 999 END AS int) AS field_order, mv AS mapping_value, av AS model_value, kind = 'match' AS is_match, similarity, kind AS difference_type,
  CASE kind WHEN 'missing' THEN 'Consider adding mapping for ''' || field || ''': ' || av
    WHEN 'extra' THEN 'Mapping found ''' || field || ''' but AI didn''t - verify accuracy'
    WHEN 'different' THEN 'Values differ - Mapping: ''' || mv || ''' vs AI: ''' || av || '''' END AS suggestion FROM k""", **_COMPARE))
def compare_fields(spark, sf):
    return comparisons(spark, sf).select(
        "page_id", "field", F.col("field_order").cast("int").alias("field_order"), "mapping_value", "model_value", "is_match", "similarity",
        "difference_type", "suggestion")


@query("field_union", truth("SELECT page_id, field FROM k", **_COMPARE))
def field_union(spark, sf):
    return comparisons(spark, sf).select("page_id", "field")


_WEIGHT = "CASE field WHEN 'vin' THEN 3.0 WHEN 'price' THEN 2.5 WHEN 'year' THEN 2.0 WHEN 'make' THEN 2.0 WHEN 'model' THEN 2.0 WHEN 'mileage' THEN 1.5 ELSE 1.0 END"


@query("overall_similarity", truth(f"""SELECT l.listing_id AS page_id, l.listing_id % 19 <> 0 AND l.listing_id % 4 < 3 AS success,
  coalesce(round(cast(x.similarity AS double), 9), 0.0) AS overall_similarity, coalesce(x.matches, 0) AS matches, coalesce(x.fields, 0) AS fields,
  CASE WHEN l.listing_id % 4 = 3 THEN 'No mapping found for site: unlisted'
    WHEN l.listing_id % 19 = 0 THEN 'AI extraction failed: Failed to parse AI response as valid JSON' END AS error
  FROM listings l LEFT JOIN (SELECT page_id, sum(similarity * {_WEIGHT}) / sum({_WEIGHT}) AS similarity,
    count(*) FILTER (WHERE kind = 'match') AS matches, count(*) AS fields FROM k GROUP BY page_id) x ON x.page_id = l.listing_id""", **_COMPARE))
def overall_similarity(spark, sf):
    both = written(pairs(spark, sf), "pairs")  # read twice: pages are mapped and answers parsed once
    return compare.page_results(both, compare.compare_fields(both)).select(
        "page_id", "success", F.round("overall_similarity", 9).alias("overall_similarity"), "matches", "fields", "error")


_EXPECTED = "field IN ('vin', 'year', 'make', 'model', 'price', 'mileage', 'color', 'dealer_name', 'dealer_phone', 'features', 'images', 'description')"


@query("coverage", truth(f"""SELECT page_id, count(*) FILTER (WHERE {_EXPECTED} AND mv <> '0') / 12.0::double AS mapping_coverage,
  count(*) FILTER (WHERE {_EXPECTED} AND av <> '0') / 12.0::double AS model_coverage FROM k GROUP BY page_id""", **_COMPARE))
def coverage(spark, sf):
    return compare.page_scores(comparisons(spark, sf)).select("page_id", "mapping_coverage", "model_coverage")


_RANK = "coalesce(list_position(['vin', 'price', 'year', 'make', 'model', 'mileage'], field), 999)"


@query("recommendations", truth(f"""SELECT x.page_id, concat_ws('|',
    CASE WHEN missing > 0 THEN 'Consider adding mappings for ' || missing || ' missing fields: ' || array_to_string(names, ', ') END,
    CASE WHEN different > 0 THEN 'Review ' || different || ' fields with different values - selectors may need refinement' END,
    CASE WHEN total_fields > successful_fields THEN 'Fix ' || (total_fields - successful_fields) || ' mapping errors for better accuracy' END,
    CASE WHEN cast(successful_fields AS double) / total_fields < 0.5 THEN 'Low mapping confidence - consider using AI-suggested selectors' END) AS advice
  FROM (SELECT page_id, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'different') AS different,
    list(field ORDER BY {_RANK}, field) FILTER (WHERE kind = 'missing') AS names FROM k GROUP BY page_id) x JOIN s ON x.page_id = s.page_id""",
    **_COMPARE, pages_=_PAGES, s=_PREVIEW))
def recommendations(spark, sf):
    return compare.page_scores(comparisons(spark, sf)).select("page_id", F.array_join("recommendations", "|").alias("advice"))


# --- suggestions ---------------------------------------------------------------------------


def _quoted(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


_DICTIONARY = "SELECT * FROM (VALUES " + ", ".join(
    f"({_quoted(d[0])}, {i}, {_quoted(w)})" for d in FIELD_DICTIONARY for i, w in enumerate(d[4])) + ") AS t(field, place, word)"
_PATTERNS = "SELECT * FROM (VALUES " + ", ".join(f"({_quoted(d[0])}, {_quoted(d[3])})" for d in FIELD_DICTIONARY if d[3]) + ") AS t(field, pattern)"
_GIVEN = """SELECT page_id, unnest(['vin', 'year', 'make', 'model', 'price', 'mileage', 'color', 'dealer_name', 'features']) AS field,
  unnest([vin, cast(year AS varchar), make, model, cast(price AS varchar), cast(mileage AS varchar), color, dealer_name, '[''Keyless Entry'', ''Heated Seats'']']) AS value FROM ans WHERE ok"""
_BY_PATTERN = """SELECT s.page_id, 1 AS strategy, s.pos AS seq, p.field, s.selector, cast(0.8 AS double) AS confidence, s.text AS value,
  'Pattern match for ' || p.pattern AS reasoning, s.text AS shown FROM strings s JOIN patterns p ON regexp_matches(s.text, p.pattern, 'i')"""
_BY_MODEL = """SELECT s.page_id, 2 AS strategy, s.pos AS seq, g.field, s.selector, cast(0.9 AS double) AS confidence, g.value,
  'AI identified this value: ' || g.value AS reasoning, s.text AS shown FROM strings s JOIN given g ON g.page_id = s.page_id AND contains(lower(s.text), lower(g.value))"""
_BY_KEYWORD = """SELECT m.page_id, 3 AS strategy, d.place * 1000 + m.pos AS seq, d.field, '.' || m.cls AS selector, cast(0.6 AS double) AS confidence,
  nullif(m.text, '') AS value, 'Keyword ''' || d.word || ''' found in class name' AS reasoning, m.text AS shown FROM marks m JOIN dictionary d ON contains(m.cls, d.word)"""
# a path counts its elements; paths from the document itself find none
_CHECKED = """SELECT *, CASE WHEN selector LIKE '[document]%' THEN 0 WHEN selector LIKE '% > li' THEN 3 WHEN selector LIKE '% > dt' OR selector LIKE '% > dd' THEN 2 ELSE 1 END AS n
  FROM (SELECT * FROM by_pattern UNION ALL SELECT * FROM by_model UNION ALL SELECT * FROM by_keyword)
  QUALIFY row_number() OVER (PARTITION BY page_id, field, selector ORDER BY strategy, seq) = 1"""
_RANKED = """SELECT c.page_id, field, selector, confidence, value, reasoning,
  cast(row_number() OVER (PARTITION BY c.page_id, field ORDER BY confidence DESC, strategy, seq) AS int) AS rank, n > 0 AS hit, cast(n AS int) AS matches,
  CASE WHEN n = 0 THEN NULL WHEN n = 3 THEN 'Keyless Entry' WHEN selector LIKE '% > dt' THEN 'Exterior color:' WHEN selector LIKE '% > dd' THEN l.color ELSE shown END AS extracted
  FROM checked c JOIN listings l ON l.listing_id = c.page_id"""
_SUGGEST = dict(strings=C.STRINGS_SQL, marks=C.MARKS_SQL, dictionary=_DICTIONARY, patterns=_PATTERNS, ans=_ANSWER, given=_GIVEN,
                by_pattern=_BY_PATTERN, by_model=_BY_MODEL, by_keyword=_BY_KEYWORD, checked=_CHECKED, ranked=_RANKED)


@query("suggest_pattern", truth("SELECT page_id, field, selector, value, confidence, reasoning FROM by_pattern", **_SUGGEST))
def suggest_pattern(spark, sf):
    found = F.concat(*[suggest.by_pattern(d[0], d[3]) for d in FIELD_DICTIONARY if d[3]])
    rows = with_dom(C.listing_pages(spark, sf)).select("page_id", F.explode(found).alias("c"))
    return rows.select("page_id", "c.field", "c.selector", "c.value", "c.confidence", "c.reasoning")


@query("suggest_keyword", truth("SELECT page_id, field, selector, value, confidence, reasoning FROM by_keyword", **_SUGGEST))
def suggest_keyword(spark, sf):
    found = suggest.by_keyword([(d[0], d[4]) for d in FIELD_DICTIONARY])
    rows = with_dom(C.listing_pages(spark, sf)).select("page_id", F.explode(found).alias("c"))
    return rows.select("page_id", "c.field", "c.selector", "c.value", "c.confidence", "c.reasoning")


def answered_pages(spark, sf):
    return suggest.with_answers(C.listing_pages(spark, sf), answers(spark, sf))


@query("suggest_model", truth("SELECT page_id, field, selector, value FROM by_model", **_SUGGEST))
def suggest_model(spark, sf):
    rows = suggest.candidate_rows(suggest.candidates(with_dom(answered_pages(spark, sf))))
    return rows.where("strategy = 2").select("page_id", "field", "selector", "value")


def ranked(spark, sf, check=False):
    return suggest.rank(suggest.candidates(with_dom(answered_pages(spark, sf)), check=check))


@query("suggest_rank", truth("SELECT page_id, field, rank, selector, confidence FROM ranked", **_SUGGEST))
def suggest_rank(spark, sf):
    return suggest.ranked_rows(ranked(spark, sf)).select("page_id", "field", "rank", "selector", "confidence")


@query("suggest_all", truth("SELECT *, rank <= 3 AS within_limit FROM ranked", **_SUGGEST))
def suggest_all(spark, sf):
    return suggest.ranked_rows(ranked(spark, sf, check=True))


@query("suggest_validate", truth("SELECT page_id, field, rank, selector, hit, extracted AS value FROM ranked", **_SUGGEST))
def suggest_validate(spark, sf):
    rows = suggest.ranked_rows(ranked(spark, sf, check=True))
    return rows.select("page_id", "field", "rank", "selector", "hit", F.col("extracted").alias("value"))


@query("suggest_coverage", truth("""SELECT l.listing_id AS page_id, count(DISTINCT field) / cast(13 AS double) AS coverage, count(field) AS suggestions
  FROM listings l LEFT JOIN ranked r ON r.page_id = l.listing_id GROUP BY 1""", **_SUGGEST))
def suggest_coverage(spark, sf):
    return suggest.suggest_coverage(ranked(spark, sf))


@query("improvements", truth("""SELECT r.page_id, r.field, rank, coalesce(w.suggestion, 'Field needs improvement') AS current_issue, selector AS suggested_selector,
  'css' AS selector_type, confidence, reasoning, value AS extracted_preview
  FROM ranked r JOIN (SELECT page_id, field, CASE kind WHEN 'missing' THEN 'Consider adding mapping for ''' || field || ''': ' || av
    ELSE 'Values differ - Mapping: ''' || mv || ''' vs AI: ''' || av || '''' END AS suggestion FROM k WHERE kind IN ('missing', 'different') AND similarity < 0.7) w
  ON w.page_id = r.page_id AND w.field = r.field""", **_COMPARE, **{n: x for n, x in _SUGGEST.items() if n != "ans"}))
def improvements(spark, sf):
    weak = suggest.with_weak(answered_pages(spark, sf), comparisons(spark, sf))
    return suggest.improvements(suggest.rank(suggest.candidates(with_dom(weak))))


@query("suggest_url", truth(f"""SELECT DISTINCT v AS url, CASE WHEN ok THEN listing_id END AS page_id, ok AS success,
  CASE WHEN ok THEN 'dealer_name|dealer_phone|features|images|make|mileage|model|price|' || CASE WHEN vin IS NOT NULL THEN 'vin|' ELSE '' END || 'year' ELSE '' END AS fields,
  CASE WHEN ok THEN (CASE WHEN vin IS NOT NULL THEN 10 ELSE 9 END) / cast(13 AS double) ELSE cast(0 AS double) END AS coverage,
  CASE WHEN NOT ok THEN 'Failed to fetch URL: ' || CASE WHEN listing_id % 8 = 7 THEN 'not in corpus' ELSE 'Invalid URL format' END END AS error
  FROM (SELECT *, {C.REQUEST_VALUE} AS v, listing_id % 8 = 1 AS ok FROM listings WHERE listing_id % 8 IN (1, 3, 7))"""))
def suggest_url(spark, sf):
    urls = C.requests(spark, sf).where("request_id % 8 IN (1, 3, 7)").select(F.col("input_value").alias("url"))
    found = suggest.for_urls(urls, C.listing_pages(spark, sf), indexed(spark, sf))
    fields = F.array_join(F.array_sort(F.array_distinct(F.col("ranked.field"))), "|")
    return found.select("url", "page_id", "success", fields.alias("fields"), "coverage", "error")


# --- search --------------------------------------------------------------------------------


@query("search_rank", truth("""SELECT vin, cast(row_number() OVER (PARTITION BY vin ORDER BY is_supported DESC, lower(title), seq) AS int) AS rank, href, domain, is_supported
  FROM h""", h=C.SEARCH_TRUTH))
def search_rank(spark, sf):
    return search.rank_hits(C.search_results(spark, sf)).select("vin", "rank", "href", "domain", "is_supported")


@query("search_top", truth("""SELECT * FROM (SELECT vin, cast(row_number() OVER (PARTITION BY vin ORDER BY is_supported DESC, lower(title), seq) AS int) AS rank, href AS url
  FROM h) WHERE rank <= 2""", h=C.SEARCH_TRUTH))
def search_top(spark, sf):
    return search.top_urls(C.search_results(spark, sf), 2)


@query("search_fallback", truth("""SELECT vin, cast(row_number() OVER (PARTITION BY vin ORDER BY is_supported DESC, lower(title), seq) AS int) AS rank, href, 'main' AS source
    FROM h WHERE listing_id % 2 = 0
  UNION ALL SELECT vin, cast(row_number() OVER (PARTITION BY vin ORDER BY seq) AS int), href, 'fallback' FROM h WHERE listing_id % 2 = 1""", h=C.SEARCH_TRUTH))
def search_fallback(spark, sf):
    hits = C.search_results(spark, sf)
    even = F.split("title", " ")[1].cast("long") % 2 == 0
    return search.with_fallback(hits.where(even), hits)


# --- pages and requests --------------------------------------------------------------------

_URLS = f"SELECT listing_id, {C.URL} AS page_url, v FROM (SELECT *, {C.REQUEST_VALUE} AS v FROM listings)"
_FETCH = """CASE WHEN listing_id % 8 = 1 THEN NULL WHEN listing_id % 8 = 7 THEN 'not in corpus' ELSE 'Invalid URL format' END"""


@query("fetch_lookup", truth(f"""SELECT listing_id AS request_id, CASE WHEN listing_id % 8 = 1 THEN listing_id END AS page_id,
  listing_id % 8 = 1 AS success, {_FETCH} AS error FROM u""", u=_URLS))
def fetch_lookup(spark, sf):
    asked = C.requests(spark, sf).withColumnRenamed("input_value", "url")
    return P.fetch_requests(asked, indexed(spark, sf)).select("request_id", "page_id", "success", "error")


@query("fetch_multiple", truth(f"""SELECT v AS url, max(CASE WHEN listing_id % 8 = 1 THEN listing_id END) AS page_id, bool_or(listing_id % 8 = 1) AS success,
  max({_FETCH}) AS error FROM u WHERE v IS NOT NULL GROUP BY v""", u=_URLS))
def fetch_multiple(spark, sf):
    asked = C.requests(spark, sf).select(F.col("input_value").alias("url"))
    return P.fetch_urls(asked.unionByName(asked), indexed(spark, sf))


@query("route", truth("""SELECT listing_id AS page_id, regexp_replace(host, '^www[.]', '') AS domain,
  CASE WHEN host = 'www.cars.com' THEN 'site' ELSE 'generic' END AS parser FROM listings"""))
def route(spark, sf):
    pages = C.listing_pages(spark, sf).drop("html")
    return pipeline.route(pages, pipeline.parser_registry(spark)).select("page_id", "domain", "parser")


@query("route_auto", truth("""SELECT listing_id AS page_id, CASE WHEN listing_id % 5 = 0 THEN 'generic' WHEN listing_id % 5 = 1 THEN 'cars.com'
  WHEN contains(host, 'cars.com') THEN 'cars.com' ELSE 'generic' END AS parser FROM listings"""))
def route_auto(spark, sf):
    asked = F.expr("CASE page_id % 5 WHEN 0 THEN 'generic' WHEN 1 THEN 'cars.com' ELSE 'auto' END")
    return C.listing_pages(spark, sf).select("page_id", pipeline.route_by_text(F.col("url"), asked).alias("parser"))


@query("vin_pages", truth(f"""SELECT vin, listing_id AS page_id, {C.URL} AS url, year || ' ' || make || ' ' || model AS title,
  cast(1 AS int) AS rank, host IN ('www.cars.com', 'carfax.com') AS is_supported, true AS within_limit FROM listings WHERE vin IS NOT NULL"""))
def vin_pages(spark, sf):
    return vin_pages_of(indexed(spark, sf)).select(
        "vin", "page_id", "url", "title", "rank", "is_supported", (F.col("rank") <= SEARCH_MAX_RESULTS).alias("within_limit"))


@query("vin_unmatched", truth("""SELECT listing_id AS request_id, 'No search results found for VIN' AS error FROM listings
  WHERE vin IS NOT NULL AND listing_id % 5 = 0"""))
def vin_unmatched(spark, sf):
    asked = C.listings(spark, sf).where("vin IS NOT NULL").select(
        F.col("listing_id").alias("request_id"), F.expr("if(listing_id % 5 = 0, reverse(vin), vin)").alias("vin"))
    seen = vin_pages_of(indexed(spark, sf), asked).select("vin")
    return asked.join(seen, "vin", "left_anti").select("request_id", F.lit(pipeline.NO_RESULTS).alias("error"))


@query("first_success", truth("""SELECT request_id, rank, ok AS success FROM (SELECT *, row_number() OVER (PARTITION BY request_id
    ORDER BY ok DESC, CASE WHEN ok THEN rank ELSE -rank END) AS n FROM t) WHERE n = 1""",
    t="SELECT listing_id AS request_id, cast(rank AS int) AS rank, (listing_id + rank) % 5 = 0 AS ok FROM (SELECT listing_id, unnest(range(1, listing_id % 4 + 2)) AS rank FROM listings)"))
def first_success(spark, sf):
    tries = C.listings(spark, sf).select(
        F.col("listing_id").alias("request_id"), F.explode(F.expr("sequence(1, cast(listing_id % 4 AS int) + 1)")).alias("rank"))
    tries = tries.withColumn("success", (F.col("request_id") + F.col("rank")) % 5 == 0)
    return pipeline.first_success(tries, "rank", "success").select("request_id", "rank", "success")


_ROUTES = f"""SELECT *, host = 'www.cars.com' AS on_site, host <> 'www.cars.com' AND {_CONF} < 0.7 AS weak FROM listings"""
_PARSED = f"""SELECT *, weak AND listing_id % 19 <> 0 AS ai, NOT weak OR listing_id % 19 <> 0 AS good,
  CASE WHEN on_site THEN 'domain-cars.com' WHEN weak AND listing_id % 19 <> 0 THEN 'ai-assisted' ELSE 'generic' END AS parser_used,
  CASE WHEN on_site THEN cast(0.9 AS double) WHEN weak AND listing_id % 19 <> 0 THEN {_ANSWER_POINTS} ELSE {_CONF} END AS conf FROM r"""
_P_YEAR = f"(CASE WHEN ai THEN {_AI_YEAR} ELSE year END)"
_P_NAMED = f"(CASE WHEN ai THEN true ELSE {_OK} END)"
_P_GOAL = f"""'Buy a ' || CASE WHEN mileage > 0 AND mileage < 30000 THEN 'low-mileage ' WHEN mileage > 100000 THEN 'high-mileage ' ELSE '' END
  || CASE WHEN (on_site OR ai) AND listing_id % 3 = 0 THEN 'clean ' ELSE '' END
  || CASE WHEN {_P_NAMED} THEN CASE WHEN {_P_YEAR} <= 2030 THEN {_P_YEAR} || ' ' ELSE '' END || make || ' ' || model
     WHEN on_site THEN year || ' ' || make || ' ' || model ELSE 'vehicle' END
  || CASE WHEN price > 0 THEN ' for $' || format('{{:,}}', price) ELSE '' END"""
_ROUTE_CTES = dict(r=_ROUTES, p=_PARSED)


def parsed(spark, sf):
    return pipeline.parse_pages(C.listing_pages(spark, sf), pipeline.parser_registry(spark), C.model_responses(spark, sf))


@query("parse_pipeline", truth(f"""SELECT listing_id AS page_id, regexp_replace(host, '^www[.]', '') AS domain, good AS success, parser_used, conf AS confidence,
  CASE WHEN NOT good THEN 'Insufficient data for confident parsing' END AS error, CASE WHEN good THEN {_P_GOAL} END AS goal FROM p""", **_ROUTE_CTES))
def parse_pipeline(spark, sf):
    return parsed(spark, sf).select("page_id", "domain", "success", "parser_used", "confidence", "error",
                                    F.when(F.col("success"), record.goal_text(F.col("vehicle"))).alias("goal"))


_N = f"""CASE WHEN on_site THEN cast(vin IS NOT NULL AS int) + 3 * cast({_OK} AS int) + cast(price IS NOT NULL AS int) + 6
  WHEN ai THEN cast(vin IS NOT NULL AS int) + 2 + cast({_AI_YEAR} <= 2030 AS int) + cast(price IS NOT NULL AS int) + 1
    + cast(listing_id % 4 <> 0 AS int) + cast(listing_id % 7 <> 0 AS int) + 1
  WHEN {_ENOUGH} THEN cast(vin IS NOT NULL AS int) + 3 * cast({_OK} AS int) + cast(price IS NOT NULL AS int) + cast(mileage > 0 AS int) + 4 ELSE 0 END"""


@query("corpus_yield", truth(f"""SELECT regexp_replace(host, '^www[.]', '') AS domain, parser_used, count(*) AS pages, cast(sum({_N}) AS bigint) AS fields_found,
  cast(sum({_N}) AS double) / (count(*) * 11) AS coverage, count(*) FILTER (WHERE good) AS successes FROM p GROUP BY 1, 2""", **_ROUTE_CTES))
def corpus_yield(spark, sf):
    return pipeline.corpus_yield(parsed(spark, sf))


_TRACE_KIND = "CASE WHEN listing_id % 8 IN (1, 3, 7) THEN 'url' ELSE 'vin' END"
_SERVED = "(listing_id % 8 = 1 OR (listing_id % 8 IN (0, 2) AND vin IS NOT NULL))"


def traces(spark, sf):
    pages, registry = C.listing_pages(spark, sf), pipeline.parser_registry(spark)
    return pipeline.process(C.requests(spark, sf), pages, registry, C.model_responses(spark, sf), index=indexed(spark, sf))


@query("pipeline_vin", truth(f"""SELECT listing_id AS request_id, {_TRACE_KIND} AS input_type,
  CASE WHEN {_SERVED} THEN {C.URL} WHEN listing_id % 8 IN (3, 7) THEN v END AS selected_url,
  {_SERVED} AND good AS success,
  CASE WHEN {_SERVED} THEN CASE WHEN NOT good THEN 'Insufficient data for confident parsing' END
    WHEN listing_id % 8 = 3 THEN 'DOM fetch failed: Invalid URL format' WHEN listing_id % 8 = 7 THEN 'DOM fetch failed: not in corpus'
    ELSE 'Invalid VIN format: ' || coalesce(v, '') END AS error,
  CASE WHEN {_SERVED} THEN parser_used WHEN listing_id % 8 IN (3, 7) THEN NULL ELSE 'vin_search' END AS parser_used,
  CASE WHEN {_SERVED} THEN conf END AS confidence, CASE WHEN {_SERVED} AND good THEN {_P_GOAL} END AS goal
  FROM (SELECT p.*, q.v FROM p JOIN q ON p.listing_id = q.request_id)""", **_ROUTE_CTES, q=_REQUESTS))
def pipeline_vin(spark, sf):
    return traces(spark, sf).select(
        "request_id", "input_type", "selected_url", "parse_result.success", "parse_result.error", "parse_result.parser_used",
        F.col("parse_result.confidence_score").alias("confidence"), F.get_json_object("final_goal", "$.goal").alias("goal"))


@query("case_requests", truth(f"""SELECT listing_id AS request_id, {_P_GOAL} AS goal, 'lotweave' AS created_by, cast(listing_id AS varchar) AS trace_request,
    trim(v) AS input_value, {_TRACE_KIND} AS input_type, {C.URL} AS selected_url, 'true' AS fetched, 'true' AS parsed, parser_used, conf AS confidence,
    cast(CASE WHEN {_TRACE_KIND} = 'vin' THEN 1 ELSE 0 END AS int) AS results
  FROM (SELECT p.*, q.v FROM p JOIN q ON p.listing_id = q.request_id) WHERE {_SERVED} AND good""", **_ROUTE_CTES, q=_REQUESTS))
def case_requests(spark, sf):
    get = lambda path: F.get_json_object("body", path)
    trace = "$.source_trace."
    return cases.case_requests(traces(spark, sf)).select(
        "request_id", get("$.goal_data.goal").alias("goal"), get("$.created_by").alias("created_by"), get(trace + "request_id").alias("trace_request"),
        F.trim(get(trace + "input_value")).alias("input_value"), get(trace + "input_type").alias("input_type"), get(trace + "selected_url").alias("selected_url"),
        get(trace + "fetch_success").alias("fetched"), get(trace + "parse_result.success").alias("parsed"),
        get(trace + "parse_result.parser_used").alias("parser_used"), get(trace + "parse_result.confidence_score").cast("double").alias("confidence"),
        F.size(F.from_json(get(trace + "search_results"), "array<string>")).alias("results"))


@query("trace_output", truth(f"""SELECT listing_id AS request_id, v AS input_value, {_TRACE_KIND} AS input_type, NOT ({_SERVED} AND good) AS skipped,
  CASE WHEN NOT ({_SERVED} AND good) THEN 'No valid goal data extracted from input' END AS error,
  CASE WHEN {_SERVED} THEN {C.URL} WHEN listing_id % 8 IN (3, 7) THEN v END AS selected_url, {_SERVED} AS fetched, {_SERVED} AND good AS parsed,
  CASE WHEN {_SERVED} AND good THEN {_P_GOAL} END AS goal, cast(CASE WHEN {_SERVED} AND {_TRACE_KIND} = 'vin' THEN 1 ELSE 0 END AS int) AS results
  FROM (SELECT p.*, q.v FROM p JOIN q ON p.listing_id = q.request_id)""", **_ROUTE_CTES, q=_REQUESTS))
def trace_output(spark, sf):
    return cases.trace_output(traces(spark, sf)).select(
        "request_id", "input_value", "input_type", "case_creation.skipped", "case_creation.error", "trace.selected_url",
        F.col("trace.fetch_success").alias("fetched"), F.col("trace.parse_result.success").alias("parsed"),
        F.get_json_object("trace.final_goal", "$.goal").alias("goal"), F.size("trace.search_results").alias("results"))
