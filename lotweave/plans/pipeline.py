"""From VIN or URL requests to goals: candidates, one parse per page, first success per request.

Every page wanted by any request is parsed once, in one pass that picks its route by domain.  After
the parse only slim result rows move: to model answers, then to the requests that asked for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.constants import SITE_CONFIDENCE
from lotweave.functions import record, web
from lotweave.operators.dom import with_dom
from lotweave.operators.lookup import keep_wanted, lookup_join
from lotweave.plans import model, rollup
from lotweave.plans.generic import LOW_CONFIDENCE, generic_fields, generic_vehicle
from lotweave.plans.site import site_vehicle
from lotweave.session import literal_rows, written
from lotweave.sources.index import PageIndex, vin_pages
from lotweave.sources.pages import fetch_urls

NO_RESULTS = "No search results found for VIN"

PARSERS = [("cars.com", "site")]


def parser_registry(spark: SparkSession) -> DataFrame:
    """Domains with a parser of their own; add rows to route more."""
    return literal_rows(spark, PARSERS, "domain", "parser")


def route(pages: DataFrame, registry: DataFrame) -> DataFrame:
    """Parser of each page by exact domain."""
    placed = pages.withColumn("domain", web.domain(F.col("url")))
    routed = lookup_join(placed, registry, "domain", salt_by="page_id", how="left")
    return routed.withColumn("parser", F.coalesce("parser", F.lit("generic")))


def route_by_text(url: Column, parser: Column) -> Column:
    """Alternative routing: a named parser, or by substring of the URL."""
    auto = F.when(F.contains(F.lower(url), F.lit("cars.com")), F.lit("cars.com")).otherwise(F.lit("generic"))
    return F.when(parser == "auto", auto).when(parser == "cars.com", parser).otherwise(F.lit("generic"))


def first_parse(pages: DataFrame, registry: DataFrame, *keep: str) -> DataFrame:
    """What a page's own route finds, and whether it is too weak to go without a model's answer."""
    dom = with_dom(route(pages, registry))
    on_site = F.col("parser") == "site"
    found = dom.select(
        "page_id", "url", "domain", "parser", *keep,
        F.when(on_site, site_vehicle()).alias("site"),
        F.when(~on_site, generic_fields()).alias("found"),
    )
    return found.select(
        "page_id", "url", "domain", "parser", *keep, "site",
        generic_vehicle(F.col("found")).alias("generic"),
        F.when(F.col("parser") == "site", SITE_CONFIDENCE)
        .otherwise(record.generic_confidence(F.col("found"))).alias("confidence"),
    ).withColumn("weak", record.needs_model(F.col("confidence")))


def answered_vehicles(answers: DataFrame, *keep: str | Column) -> DataFrame:
    """Parsed answers as vehicles.

    Failed answers stay as nulls: a filter would be pushed below their parsing and parse twice.
    """
    return answers.select(
        F.col("page_id").alias("_page"), model.vehicle_of(F.col("fields")).alias("ai"),
        F.col("success").alias("_ok"), F.col("confidence").alias("ai_confidence"), *keep,
    )


def settled(given: DataFrame, *keep: str) -> DataFrame:
    """The result of a first parse beside the answer that it got, if any (ai, ai_confidence, has_ai)."""
    good = ~F.col("weak") | F.col("has_ai")
    return given.select(
        "page_id", "url", "domain", *keep,
        good.alias("success"),
        F.when(F.col("parser") == "site", F.concat(F.lit("domain-"), F.col("domain")))
        .when(F.col("has_ai"), F.lit("ai-assisted")).otherwise(F.lit("generic")).alias("parser_used"),
        F.when(F.col("has_ai"), F.col("ai_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(~good, F.lit(LOW_CONFIDENCE)).alias("error"),
        F.when(F.col("parser") == "site", F.col("site")).when(F.col("has_ai"), F.col("ai"))
        .otherwise(F.col("generic")).alias("vehicle"),
    )


def with_answers(first: DataFrame, answers: DataFrame) -> DataFrame:
    """First parses with the answers of the weak ones, given as they came (response) or parsed (fields).

    The weak flag is part of the join condition: only those rows look up an answer.  Answers as they
    came are parsed behind the join, so that one nobody asks for costs a lookup key and no more.
    """
    asked = F.col("weak") & (F.col("page_id") == F.col("_page"))
    if "response" in answers.columns:
        met = first.withColumnRenamed("confidence", "_own").join(
            answers.select(F.col("page_id").alias("_page"), "response"), asked, "left"
        )
        own = [F.col("_own").alias(c) if c == "confidence" else c for c in first.columns]
        given = answered_vehicles(model.parse_answers(met), *own)
    else:
        given = first.join(answered_vehicles(answers), asked, "left")
    return given.withColumn("has_ai", F.coalesce("_ok", F.lit(False)))


def parse_pages(pages: DataFrame, registry: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Parse result per page: (page_id, url, domain, success, parser_used, confidence, error, vehicle).

    ``answers`` are a model's (page_id, response), best left unparsed, or what `model.parse_answers` made of them.
    """
    first = first_parse(pages, registry)
    if answers is None:
        given = first.select("*", F.lit(None).cast("double").alias("ai_confidence"),
                             F.lit(None).cast(first.schema["generic"].dataType).alias("ai"), F.lit(False).alias("has_ai"))
    else:
        given = with_answers(first, answers)
    return settled(given)


def typed_requests(requests: DataFrame) -> DataFrame:
    """Requests with their kind and the reason why none can be served, if so."""
    given = F.col("input_type") if "input_type" in requests.columns else F.lit(None).cast("string")
    kind = F.coalesce(given, web.input_type(F.col("input_value")))
    rows = requests.withColumn("input_type", kind)
    bad_vin = (F.col("input_type") == "vin") & ~web.is_vin(F.col("input_value"))
    return rows.withColumn(
        "request_error",
        F.coalesce(
            web.route_error(F.col("input_type")),
            F.when(bad_vin, F.concat(F.lit("Invalid VIN format: "), F.coalesce("input_value", F.lit("")))),
        ),
    )


def candidates(requests: DataFrame, pages: PageIndex | DataFrame, limit: int | None = None) -> DataFrame:
    """Pages to try per request (the best ``limit`` of a VIN, or all): (request_id, rank, url, page_id, fetch_error)."""
    ok = requests.where(F.col("request_error").isNull())
    vins = ok.where(F.col("input_type") == "vin").select(
        "request_id", web.clean_vin(F.col("input_value")).alias("vin")
    )
    hits = vins.join(vin_pages(pages, vins, limit), "vin").select(
        "request_id", "rank", "url", "page_id", F.lit(None).cast("string").alias("fetch_error"),
        "title", "domain", "is_supported",
    )
    asked = ok.where(F.col("input_type") == "url").select("request_id", F.col("input_value").alias("url"))
    fetched = fetch_urls(asked, pages)
    direct = asked.join(fetched, "url").select(
        "request_id", F.lit(1).alias("rank"), "url", "page_id", F.col("error").alias("fetch_error"),
        F.lit(None).cast("string").alias("title"), web.domain(F.col("url")).alias("domain"),
        F.lit(None).cast("boolean").alias("is_supported"),
    )
    return hits.unionByName(direct)


def first_success(tries: DataFrame, *result: str) -> DataFrame:
    """Per request the best-ranked success, else the last one tried."""
    order = F.struct(
        (~F.col("success")).alias("a"),
        F.when(F.col("success"), F.col("rank")).otherwise(-F.col("rank")).alias("b"),
    )
    return tries.groupBy("request_id").agg(F.min_by(F.struct(*result), order).alias("r")).select(
        "request_id", "r.*"
    )


def process(
    requests: DataFrame, pages: DataFrame, registry: DataFrame, answers: DataFrame | None = None, limit: int | None = None,
    index: PageIndex | None = None,
) -> DataFrame:
    """One trace per request (request_id, input_value[, input_type]); ``limit`` is the search's, per VIN.

    With an ``index`` of the pages no body is read to find them.

    Typed requests, candidates and parse results are written to the shared folder, since all are read
    more than once: a request is typed once, the corpus is searched once and a page parsed once.  The
    choice among a request's candidates moves outcomes only; the vehicle of the one chosen page is
    joined afterwards.
    """
    # stored: filters on kind and error would else sink to the scan and type all requests in its few tasks, each time
    asked = written(typed_requests(requests).select("request_id", "input_value", "input_type", "request_error"), "asked")
    tries = written(candidates(asked, index or pages, limit), "candidates")
    results = parse_pages(keep_wanted(pages, tries, "page_id"), registry, answers)
    parsed = written(results.select("page_id", "success", "parser_used", "confidence", "error", "vehicle"), "parsed")
    outcomes = parsed.select("page_id", "success", "parser_used", "confidence", "error")
    tried = tries.join(outcomes, "page_id", "left").withColumn(
        "success", F.coalesce("success", F.lit(False))
    ).withColumn(
        "error",
        F.when(F.col("fetch_error").isNotNull(), F.concat(F.lit("DOM fetch failed: "), F.col("fetch_error")))
        .otherwise(F.col("error")),
    )
    chosen = first_success(tried, "page_id", "url", "fetch_error", "success", "parser_used", "confidence", "error")
    vehicles = parsed.where("success").select("page_id", "vehicle")
    chosen = chosen.join(vehicles, (chosen["page_id"] == vehicles["page_id"]) & chosen["success"], "left").drop("page_id")
    listed = tries.where(F.col("title").isNotNull()).groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", F.col("url").alias("href"), "domain", "is_supported")))
        .alias("search_results")
    )
    rows = asked.join(chosen, "request_id", "left").join(listed, "request_id", "left")
    is_vin = F.col("input_type") == "vin"
    lost = F.col("url").isNull()
    return rows.select(
        "request_id", "input_value", "input_type",
        F.coalesce("search_results", F.array().cast(listed.schema["search_results"].dataType)).alias("search_results"),
        F.col("url").alias("selected_url"),
        (~lost & F.col("fetch_error").isNull()).alias("fetch_success"),
        "fetch_error",
        F.struct(
            F.coalesce("success", F.lit(False)).alias("success"),
            F.coalesce("request_error", F.when(lost & is_vin, F.lit(NO_RESULTS)), F.col("error")).alias("error"),
            F.when(F.col("request_error").isNotNull() & is_vin, F.lit("vin_search"))
            .when(lost & is_vin, F.lit("search")).otherwise(F.col("parser_used")).alias("parser_used"),
            F.col("confidence").alias("confidence_score"),
        ).alias("parse_result"),
        F.when(F.coalesce("success", F.lit(False)), record.goal_json(F.col("vehicle"))).alias("final_goal"),
    )


def corpus_yield(parsed: DataFrame) -> DataFrame:
    """Pages and mean share of filled fields per domain and parser."""
    return rollup.merged_yield(rollup.yield_state(parsed))
