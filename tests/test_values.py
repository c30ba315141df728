import pytest
from pyspark.sql import functions as F

from lotweave.functions import record, values, web
from lotweave.plans.compare import with_similarity


def one(spark, col):
    return spark.range(1).select(col.alias("v")).head().v


@pytest.mark.parametrize("vin, ok", [
    ("5TDGZRBHXMS103005", True), ("1HGCM82633A123456", True), ("WBAFR7C59BC123456", True), (" 1hgcm82633a123456 ", True),
    ("123456789", False), ("123456789012345678", False), ("5TDGZRBHXMS10I005", False), ("5TDGZRBHXMS10O005", False), ("", False), (None, False)])
def test_vin(spark, vin, ok):
    assert one(spark, web.is_vin(F.lit(vin).cast("string"))) is ok


@pytest.mark.parametrize("value, kind", [
    ("https://a.b/c", "url"), ("www.a.b", "url"), ("1HGCM82633A123456", "vin"), ("//host/x", "url"), ("hello", "vin"), ("ftp://h/x", "url"), ("", "vin")])
def test_input_type(spark, value, kind):
    assert one(spark, web.input_type(F.lit(value))) == kind


@pytest.mark.parametrize("src, want", [
    ("x.jpg", "https://h.com/a/x.jpg"), ("./x.jpg", "https://h.com/a/x.jpg"), ("../x.jpg", "https://h.com/x.jpg"), ("/x/../y", "https://h.com/y"),
    ("//c.com/z", "https://c.com/z"), ("http://o.com/", "http://o.com/"), ("?q=2", "https://h.com/a/b?q=2"), ("#f", "https://h.com/a/b?q=1#f"), ("", "https://h.com/a/b?q=1")])
def test_absolute_urls(spark, src, want):
    assert one(spark, web.absolute(F.lit(src), F.lit("https://h.com/a/b?q=1"))) == want


def test_domain(spark):
    got = [one(spark, web.domain(F.lit(u))) for u in ("https://WWW.Cars.com:80/x", "https://m.cars.com", "nothing")]
    assert got == ["cars.com:80", "m.cars.com", None]


@pytest.mark.parametrize("text, want", [("$31,650", 31650), ("call", None), ("$0", None), ("1.2.3", None), ("$19.99", 19)])
def test_site_price(spark, text, want):
    assert one(spark, values.site_price(F.lit(text))) == want


def test_modal_price_prefers_count_then_first(spark):
    price = lambda t: one(spark, values.modal_price(values.text_prices(F.lit(t))))
    assert price("$20,000 was $25,000 now $20,000") == 20000
    assert price("$30,000 or $25,000") == 30000
    assert price("$5 and $900,000") is None
    assert price("MSRP: 45000") == 45000


def test_text_mileage_range_moves_to_next_pattern(spark):
    assert one(spark, values.text_mileage(F.lit("900,000 miles. Mileage: 12,000"))) == 12000
    assert one(spark, values.text_mileage(F.lit("none"))) is None


def test_titles(spark):
    assert tuple(one(spark, values.text_title(F.lit("Used 2021 Citroën C3 Aircross ")))) == (2021, "Citroën", "C3 Aircross", "Used 2021 Citroën C3 Aircross ")
    assert one(spark, values.text_title(F.lit("2050 Ford Focus"))) is None
    assert tuple(one(spark, values.site_title(F.lit("2021 Toyota Camry LE")))) == (2021, "Toyota", "Camry LE")
    assert tuple(one(spark, values.site_title(F.lit("Toyota Camry")))) == (None, None, None)


def test_goal_text_golden(spark):
    v = record.vehicle({"vin": F.lit("5TDGZRBHXMS103005"), "make": F.lit("Toyota"), "model": F.lit("Highlander XLE"),
                        "year": F.lit(2021), "price": F.lit(31650), "mileage": F.lit(56630)})
    assert one(spark, record.goal_text(v)) == "Buy a 2021 Toyota Highlander XLE for $31,650"
    low = record.vehicle({"mileage": F.lit(100), "accidents": F.lit(False), "listing_title": F.lit("Nice van")})
    assert one(spark, record.goal_text(low)) == "Buy a low-mileage clean Nice van"
    assert one(spark, record.goal_text(record.vehicle({}))) == "Buy a vehicle"


def test_goal_json_drops_nulls_keeps_empty_lists(spark):
    assert one(spark, record.goal_json(record.vehicle({"price": F.lit(-1), "year": F.lit(1700)}))) == '{"goal":"Buy a vehicle","features":[],"images":[]}'


def test_coercion_voids_the_record(spark):
    r = one(spark, record.coerced({"mileage": F.lit("45,000 miles"), "vin": F.lit("x")}))
    assert r.record_valid is False and r.vehicle is None
    r = one(spark, record.coerced({"mileage": F.lit(" 45 "), "dealer_rating": F.lit("9")}))
    assert r.record_valid and r.vehicle.mileage == 45 and r.vehicle.dealer_rating is None


def test_clean_text_quirk_any_price_text_becomes_a_number(spark):
    assert one(spark, values.clean_any(F.lit("<b>Only $1,200</b>  now")))["value"] == "1200"
    assert one(spark, values.clean_any(F.lit("price of 2 cars")))["number"] == 2
    assert one(spark, values.clean_any(F.lit(" a \n b ")))["value"] == "a b"


def test_similarity(spark):
    import difflib

    rows = [("Toyota", "toyota "), ("30,000", "33000"), ("0", "5"), ("$5", "$6"), ("Highlander", "Highlander XLE"), (None, "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    got = {r.i: r.similarity for r in with_similarity(df, "a", "b").collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert got[0] == 1.0 and got[1] == pytest.approx(1 - 3000 / 33000) and got[2] == 0.0
    assert got[3] == ratio("$5", "$6") and got[4] == ratio("highlander", "highlander xle") and got[5] is None
