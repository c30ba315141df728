import json
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from lotweave.operators.dom import with_dom
from lotweave.operators.lookup import lookup_join
from lotweave.session import literal_rows
from lotweave.plans import generic, mapping, model, pipeline, schemas, search, site, suggest
from lotweave.sources.index import vin_pages
from lotweave.sources import cases
from lotweave.sources import pages as P
from lotweave.sources.rules import built_in_configs, read_rule_files, rule_rows, rule_sets
from lotweave.streaming import intake

VIN = "5TDGZRBHXMS103005"


def ruled(spark, pages, config, *htmls):
    configs = spark.createDataFrame([("s", json.dumps(config))], "site_id string, config string")
    dom = with_dom(pages(*htmls)).withColumn("site_id", F.lit("s"))
    return mapping.with_rules(dom, rule_sets(rule_rows(configs)))


def test_site_quirks(pages):
    html = (f'<span data-qa="vin-value">not a vin</span><p>VIN: {VIN}</p><p>Driven <b>about</b> 1,234 miles in 2020</p>'
            '<div class="price-display"><i class="primary-price">call</i></div><b class="listing-price">$9,999</b>'
            '<div class="vehicle-details"><dl><dt>Color:</dt><dd>Red</dd><dt>x</dt></dl><i class="key">Engine</i><i class="value">V6</i></div>'
            '<a href="tel:1">Call 555-123 4567 now</a><!-- accident --><p>accident</p>')
    v = site.parse_site(with_dom(pages(html))).head()
    assert v.vehicle.vin is None  # an element that is no VIN blocks the text fallback
    assert v.vehicle.mileage is None or v.vehicle.mileage == 1234
    assert v.vehicle.price == 9999  # the first selector with a readable price wins
    assert (v.vehicle.color, v.vehicle.engine) == (None, "V6")  # unequal dt/dd are not paired
    assert v.vehicle.dealer_phone == "555-1234567" and v.vehicle.accidents is False and v.confidence == 0.9


def test_site_mileage_takes_first_number_of_the_parent(pages):
    r = site.parse_site(with_dom(pages("<p><b>2 owners</b> 45,000 miles</p>"))).head()
    assert r.vehicle.mileage == 2


def test_generic_quirks(pages):
    html = f"<h1>Sale</h1><title>x</title><h2>2020 Kia Rio</h2><p>VIN: {VIN[:9]}</p><p>{VIN[9:]}</p><p> 0 miles</p><img src='a.png' width='x' height='10'>"
    r = generic.parse_generic(with_dom(pages(html))).head()
    assert r.found.vin == VIN  # adjacent text nodes join without a separator
    assert r.found.mileage is None and (r.found.make, r.found.year) == ("Kia", 2020) and list(r.found.images) == ["a.png"]
    assert r.confidence == 0.75 and r.success


def test_model_input_prefers_main_and_caps_lines_if_asked(pages):
    body = "".join(f"<p>line number {i}</p>" for i in range(150))
    r = with_dom(pages(f"<nav>navigation</nav><main>{body}<p>123456789</p></main><p>outside main</p>",
                       "<form>form text</form><p>short</p><p>long enough</p>")).select("page_id", generic.model_input().alias("t"), generic.model_input(100).alias("some")).collect()
    got = {x.page_id: x.t.split("\n") for x in r}
    assert got[0] == [f"line number {i}" for i in range(150)] and got[1] == ["long enough"]
    assert r[0].some.split("\n") == got[0][:100]


def test_mapping_single_feature_voids_record_and_list_rules_find_nothing(spark, pages):
    r = mapping.map_vehicles(mapping.map_fields(ruled(spark, pages, {"vin": ".v", "features": ".f li", "make": [".v"]},
                             "<p class='v'>x</p><ul class='f'><li>one</li></ul>", "<p class='v'>x</p><ul class='f'><li>a</li><li>b</li></ul>")))
    got = {x.page_id: x for x in r.collect()}
    assert got[0].record_valid is False and got[0].vehicle is None and got[0].fields_mapped == 2
    assert got[1].vehicle.features == ["a", "b"] and got[1].fields_total == 3 and got[1].fallback_needed


def test_preview_errors_and_types(spark, pages):
    config = {"_metadata": {}, "goal": "Buy", "price": {"selector": ".p"}, "vin": "//b/text()", "color": ".none", "trim": ".a + .b",
              "photo": ".img", "model": {"type": "css"}, "q": "#q"}
    r = mapping.preview(ruled(spark, pages, config, "<i class='p'>$1,500</i><b>X</b><b>Y</b><img class='img'><input id='q' value='7'>")).head()
    got = {f.field: f for f in r.fields}
    assert got["price"].number == 1500 and got["vin"]["values"] == ["X", "Y"] and got["q"].value == "7"
    assert not got["photo"].success and got["photo"].error is None  # an image without a source is no error and no value
    assert r.errors == ["color: No elements found with selector", "trim: CSS extraction failed", "model: No selector provided"]
    assert (r.successful_fields, r.total_fields) == (4, 8)


@pytest.mark.parametrize("answer, want", [
    ('{"price": "45.5", "year": -5, "owners": true, "accidents": "YES", "make": " A ", "model": " "}',
     {"price": 455, "year": -5, "owners": 1, "accidents": True, "make": "A"}),
    ('text {"vin": 5, "features": ["a", " ", "b "], "images": "x"} text', {"features": ["a", "b"]}),
    ('[1]', None), ("nothing", None), ('{"a": 1}', None), ('{"price": 1.9, "mileage": null}', {"price": 1}),
])
def test_answers(spark, answer, want):
    df = spark.createDataFrame([(1, "m", 2, answer)], "page_id long, model_used string, tokens_used int, response string")
    r = model.parse_answers(df).head()
    got = r.fields and {k: v for k, v in r.fields.asDict().items() if v is not None}
    assert got == want and r.success == (want is not None)


def test_rule_files_and_broken_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"vin": ".v", "goal": "Buy"}')
    (tmp_path / "bad.json").write_text("{")
    rows = rule_rows(read_rule_files(spark, str(tmp_path)))
    assert [(r.site_id, r.field, r.ordinal) for r in rows.orderBy("ordinal").collect()] == [("good", "vin", 1), ("good", "goal", 2)]
    assert schemas.available_sites(read_rule_files(spark, str(tmp_path))).count() == 1


def test_built_in_mappings_validate(spark):
    got = {r.site_id: (r.valid, r.fields_count) for r in schemas.validate_mapping(built_in_configs(spark)).collect()}
    assert got == {"cars_com": (True, 26), "carfax": (True, 26), "default": (True, 14)}
    listed = {r.site_id: r.field_count for r in schemas.list_schemas(built_in_configs(spark)).collect()}
    assert listed == {"cars_com": 25, "carfax": 25, "default": 13}


def test_html_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>x</h1>\n<p>y</p>")
    r = P.read_html_files(spark, str(tmp_path)).head()
    assert r.url.startswith("file:///") and r.url.endswith("/a.html") and "<p>y" in r.html


def test_page_copies_and_repeated_requests(spark, pages):
    asked = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://a.com/x"), (3, "bad"), (4, None)], "request_id long, url string")
    got = {r.request_id: (r.page_id, r.error) for r in P.fetch_requests(asked, pages("a", "b", url="https://a.com/x")).collect()}
    assert got == {1: (0, None), 2: (0, None), 3: (None, P.INVALID_URL), 4: (None, P.INVALID_URL)}


def test_lookup_join_gives_the_same_rows_with_salts(spark):
    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('k', id % 50)) AS k")
    small = literal_rows(spark, [("hot", 1), *[(f"k{i}", i) for i in range(40)]], "k", "v")
    a = lookup_join(big, small, "k", "id", "left")
    b = lookup_join(big, small, "k", "id", "left", salts=16)
    assert sorted(a.select("id", "v").collect()) == sorted(b.select("id", "v").collect()) and b.count() == 1000
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()


def test_search_cap_ranking_and_fallback(spark):
    rows = [("V", f"t{9 - i}", f"https://h{i}.com/", "", i) for i in range(9)] + [("V", "a", "https://www.cars.com/", "", 9), ("V", "b", "https://carfax.com/", "", 10)]
    hits = spark.createDataFrame([*rows, ("W", "t", "nope", "", 0)], "vin string, title string, href string, snippet string, seq int")
    top = search.rank_hits(hits).where("vin = 'V'").orderBy("rank").collect()
    assert len(top) == 11 and [t.href for t in top[:2]] == ["https://www.cars.com/", "https://carfax.com/"]  # ranked before any cut
    assert [t.href for t in search.rank_hits(hits, 3).where("vin = 'V'").orderBy("rank").collect()] == [t.href for t in top[:3]]
    spare = spark.createDataFrame([("W", "t", f"https://s{i}.com/", "", i) for i in range(8)], hits.schema)
    assert search.with_fallback(hits, spare, 5).where("vin = 'W'").count() == 5
    got = search.with_fallback(hits, spare).where("vin = 'W'").collect()
    assert len(got) == 8 and {g.source for g in got} == {"fallback"}


def test_first_success_keeps_last_failure(spark):
    tries = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False), (2, 2, False)], "request_id long, rank int, success boolean")
    got = {r.request_id: r.rank for r in pipeline.first_success(tries, "rank").collect()}
    assert got == {1: 2, 2: 2}


def test_requests_end_to_end(spark, pages):
    page = f"<html><head><title>t</title></head><h1 class='listing-title'>2020 Kia Rio LX</h1><p data-qa='vin-value'>{VIN}</p></html>"
    asked = spark.createDataFrame([(1, VIN.lower(), None), (2, "https://www.cars.com/d/1/", "url"), (3, "1HGCM82633A123456", None), (4, "x", "phone"), (5, "short", None)],
                                  "request_id long, input_value string, input_type string")
    got = {r.request_id: r for r in pipeline.process(asked, pages(page), pipeline.parser_registry(spark)).collect()}
    assert got[1].final_goal == got[2].final_goal and '"vin":"' + VIN in got[1].final_goal and len(got[1].search_results) == 1
    assert got[3].parse_result.error == pipeline.NO_RESULTS and got[3].parse_result.parser_used == "search"
    assert got[4].parse_result.error == "Unsupported input type: phone" and got[5].parse_result.error == "Invalid VIN format: short"
    rows = spark.createDataFrame(list(got.values()), pipeline.process(asked, pages(page), pipeline.parser_registry(spark)).schema)
    assert cases.case_requests(rows).count() == 2
    assert {r.request_id: r.case_creation.skipped for r in cases.trace_output(rows).collect()} == {1: False, 2: False, 3: True, 4: True, 5: True}


def test_suggestions_dedupe_and_rank(pages):
    html = f"<p class='vin'>{VIN}</p><p class='vin'>{VIN}</p><i id='my-vin'>a</i><b data-vin='1'>b</b>"
    got = suggest.ranked_rows(suggest.rank(suggest.candidates(with_dom(pages(html)), ["vin"]))).orderBy("rank").collect()
    assert [(g.selector, g.confidence) for g in got] == [(".vin", 0.8), ("[document] > b", 0.8), ("#my-vin", 0.7)]
    assert suggest.ranked_rows(suggest.rank(suggest.candidates(with_dom(pages(html)), ["vin"]), top=2)).count() == 2
    none = suggest.suggest_coverage(suggest.rank(suggest.candidates(with_dom(pages("<p>x</p>"))))).head()
    assert (none.coverage, none.suggestions) == (0.0, 0)


def test_schema_update_keeps_version_and_create_conflicts(spark):
    old = spark.createDataFrame([("s", '{"_metadata": {"version": "3.1.0"}, "vin": ".v", "goal": "g"}')], "site_id string, config string")
    new = spark.createDataFrame([("s", '{"vin": ".w", "goal": "g"}'), ("t", '{"vin": ".w", "goal": "g"}')], "site_id string, config string")
    doc = json.loads(schemas.update_schemas(old, new).head().config)
    assert doc["vin"] == ".w" and doc["_metadata"]["version"] == "3.1.0" and doc["_metadata"]["site_id"] == "s"
    assert {r.site_id: r.status for r in schemas.create_schemas(old, new).collect()} == {"s": "conflict", "t": "created"}


def test_metadata_keeps_its_types_and_long_configs_stay_whole(spark):
    long = "x" * 200_000
    old = spark.createDataFrame([("s", '{"_metadata": {"n": 5, "on": true, "tags": ["a"], "o": {"x": true}}, "vin": ".v", "goal": "g"}')], "site_id string, config string")
    new = spark.createDataFrame([("s", '  {"vin": ".w", "goal": "' + long + '"}')], "site_id string, config string")
    doc = json.loads(schemas.update_schemas(old, new).head().config)
    assert doc["goal"] == long and {k: doc["_metadata"][k] for k in ("n", "on", "tags", "o")} == {"n": 5, "on": True, "tags": ["a"], "o": {"x": True}}
    assert doc["_metadata"]["site_id"] == "s" and doc["_metadata"]["version"] == "1.0.0"


def test_empty_and_unreadable_configs_are_reported(spark):
    configs = spark.createDataFrame([("e", "{}"), ("u", "{"), ("l", "[1]")], "site_id string, config string")
    missing = ["Missing required field: vin", "Missing required field: goal"]
    got = {r.site_id: (r.valid, r.errors, r.fields_count) for r in schemas.validate_mapping(configs).collect()}
    assert got["e"] == (False, missing, 0) and got["u"][:2] == (False, ["Mapping not found for site: u"]) and got["l"][0] is False
    assert {r.site_id: r.errors for r in schemas.validate_config(configs).collect()} == {"e": missing, "u": ["unreadable"], "l": ["unreadable"]}
    assert {r.site_id: r.validation.valid for r in schemas.mapping_info(configs).collect()} == {"e": False, "u": False, "l": False}


def test_best_page_of_a_vin_comes_first_whatever_its_id(spark):
    rows = [(i, f"https://h{i}.com/", f"<title>t{i}</title> {VIN}") for i in range(14)] + [(90, "bad", f"{VIN}"), (99, "https://www.cars.com/d/1/", f"<title>z</title>{VIN} {VIN}")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = vin_pages(table).orderBy("rank").collect()
    assert len(got) == 15 and got[0].page_id == 99 and got[0].is_supported
    assert [r.page_id for r in vin_pages(table, limit=3).orderBy("rank").collect()] == [r.page_id for r in got[:3]]


def test_a_third_of_requests_for_one_vin(spark):
    table = spark.createDataFrame([(1, "https://www.cars.com/d/1/", f"<p data-qa='vin-value'>{VIN}</p>"), (2, "https://x.com/2", "<h1>2020 Kia Rio</h1>")], "page_id long, url string, html string")
    asked = spark.range(300).selectExpr("id as request_id", f"if(id % 3 = 0, '{VIN}', concat('https://x.com/', id % 9)) as input_value")
    got = pipeline.process(asked, table, pipeline.parser_registry(spark))
    rows = {r.request_id: r for r in got.collect()}
    assert len(rows) == 300 and all(rows[i].selected_url == "https://www.cars.com/d/1/" for i in range(0, 300, 3))


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(1, "https://www.cars.com/1", "<p data-qa='vin-value'>" + VIN, "2026-01-01 00:00:00"), (2, "https://www.cars.com/1", "<p>copy", "2026-01-01 00:01:00"),
            (3, "https://x.com/2", "<h1>2020 Kia Rio</h1> VIN: " + VIN, "2026-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, t string").withColumn("fetched_at", F.to_timestamp("t")).drop("t")
    df.write.parquet(f"{tmp_path}/in")
    registry = pipeline.parser_registry(spark)
    q = intake.run_intake(intake.page_stream(spark, f"{tmp_path}/in"), registry, f"{tmp_path}/out", f"test-{uuid4().hex}", once=True, checkpoint=f"{tmp_path}/state")
    q.awaitTermination(120)
    got = spark.read.json(f"{tmp_path}/out").select("url", "goal").collect()
    assert len(got) == 2
    want = intake.goals(df.where("page_id = 3").drop("fetched_at"), registry).head().goal
    assert {r.goal for r in got if r.url == "https://x.com/2"} == {want}


def test_preview_documents(spark, pages):
    config = {"goal": "Buy", "vin": ".v", "price": ".p", "features": "//li/text()", "dealer.name": ".d", "dealer.phone": ".t", "make": ".m", "trim": ".none"}
    html = f"<b class='v'>{VIN}</b><i class='p'>$9,500</i><ul><li>a</li><li>b</li></ul><b class='d'>Al</b><b class='t'>555</b><b class='m'>Kia</b>"
    rows = mapping.preview_documents(mapping.preview(ruled(spark, pages, config, html, html.replace("<li>b</li>", ""), "<p></p>"))).orderBy("page_id").collect()
    assert json.loads(rows[0].extracted_data) == {
        "goal": "Buy", "vin": VIN, "price": 9500, "features": ["a", "b"], "dealer": {"name": "Al", "phone": "555"}, "make": "Kia"}
    assert json.loads(rows[0].goal)["dealer"] == {"name": "Al", "phone": "555"} and json.loads(rows[0].goal)["price"] == 9500
    assert rows[1].goal is None and json.loads(rows[1].extracted_data)["features"] == "a"  # one string is no list: the goal is void
    assert json.loads(rows[2].extracted_data) == {"goal": "Buy"}
