"""Golden values of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from shelfline.functions import formatting, numbers, text, urls, validate
from shelfline.functions.js import decoded, leading_number, round_half_up, squeeze
from shelfline.operators import filters, insights, ranking


def check(spark, function, pairs, kind="string"):
    """``function`` of a column gives what the pairs say."""
    rows = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(pairs)], f"k int, x {kind}").select("k", function(F.col("x")).alias("y")).orderBy("k").collect()
    assert {pairs[r.k][0]: r.y for r in rows} == dict(pairs)


def test_prices(spark):
    check(spark, numbers.indian_number, [
        ("₹999", 999), ("₹1,099", 1099), ("₹12,999", 12999), ("₹1,29,999", 129999), ("1,29,999", 129999), ("₹1,099.50", 1099.5), ("Rs. 999", 999), ("not a price", None), ("", None), ("Rs. 999 Rs.", None), (None, None),
    ])


def test_counts(spark):
    check(spark, numbers.feedback_count, [
        ("92,431 ratings", 92431), ("9,876 ratings", 9876), ("1,234 customer reviews", 1234), ("1.2K ratings", 1200), ("12.4K ratings", 12400), ("1 lakh+ ratings", 100000), ("1,234", 1234), ("500", 500),
        ("1M reviews", 1000000), ("1.2 crore ratings", 12000000), ("4.6 out of 5 stars", None), ("35% off", None), ("", None), ("1,234K", 234000),
    ])


def test_plausible(spark):
    plausible = lambda c: numbers.plausible_count(c, numbers.feedback_count(c))
    check(spark, plausible, [("35% off", False), ("1K+ bought in past month", False), ("3,000+ bought in past month", False), ("92,431 ratings", True), ("99", False), ("100", True), ("(1,234)", False), ("12K", True)])


def test_site_counts(spark):
    check(spark, lambda c: numbers.meesho_count(c, "rating", True), [("12.4K Ratings", 12400), ("1.2L Ratings", 120000), ("(1,234)", 1234)])
    check(spark, lambda c: numbers.flipkart_count(c, "rating"), [("12,345 Ratings", 12345), ("(1,234)", 1234), ("12.4K Ratings", 12)])


def test_validation(spark):
    check(spark, validate.is_title, [("Wireless Earbuds", True), (None, False), ("", False), ("   ", False), ("ab", False), ("Sponsored", False), ("Untitled", False)])
    check(spark, validate.strict_id, [("B0ABCDEF12", "B0ABCDEF12"), (" b0abcdeF12 ", "B0ABCDEF12"), ("B0ABC", None), ("B0ABCDEF12345", None), ("B0ABC!@#12", None), (None, None)])
    check(spark, validate.is_rating, [(0.0, True), (3.8, True), (5.0, True), (5.1, False), (-1.0, False), (math.inf, False), (None, False)], "double")
    check(spark, validate.is_count, [(0.0, True), (100.0, True), (1.2, False), (-500.0, False), (math.inf, False), (None, False)], "double")
    assert spark.range(1).select(validate.is_price(F.lit(float("nan"))), validate.is_price(F.lit(0.0)), validate.is_price(F.lit(-999.0))).first() == (False, True, False)
    check(spark, validate.is_image, [("https://x/a.jpg", True), ("data:abc", False), ("javascript:x", False), ("", False), (None, False)])
    check(spark, urls.is_product_url, [
        ("https://www.amazon.in/dp/B0ABCDEF12", True), ("/gp/product/B0ABCDEF12", True), (None, False), ("", False), ("#", False), ("javascript:void(0)", False), ("/product-reviews/B0", False), ("/gp/wishlist", False), ("https://www.google.com/search", False),
    ])


def test_urls(spark):
    check(spark, urls.product_url, [("/boAt-Rockerz-450/dp/b0abcdef12/ref=sr_1_1?keywords=boat", "https://www.amazon.in/dp/B0ABCDEF12"), ("https://www.amazon.in/a/b/?x=1", "/a/b"), ("", None)])
    check(spark, urls.query_param, [("https://www.amazon.in/s?k=wireless+airpods", "wireless airpods"), ("https://www.amazon.in/s?k=usb%20c%20cable&page=2", "usb c cable"), ("", ""), (None, ""), ("/s?k=50%", "50%")])
    check(spark, urls.canonical_page, [("https://www.amazon.in/s/?page=2&ref=x&k=a&k=a#top", "https://www.amazon.in/s?k=a&page=2"), ("", ""), (None, "")])
    check(spark, urls.srcset_best, [("a53C.jpg 200w, a54D.jpg 400w", "a54D.jpg"), ("", None), (None, None), ("a.jpg 2x, b.jpg 2x", "a.jpg")])
    check(spark, urls.site_of_host, [("amazon.in", "Amazon"), ("www.amazon.com", "Amazon"), ("m.amazon.in", None), ("flipkart.com", "Flipkart"), (None, None), ("", None)])


def test_canonical_page_is_idempotent(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(urls.canonical_page(F.col("url")).alias("c"))
    assert pages.where(urls.canonical_page(F.col("c")) != F.col("c")).isEmpty()


def test_admission(spark):
    origin = F.lit("https://www.amazon.in/s?k=earbuds")
    check(spark, lambda c: urls.admission(c, origin), [
        ("/s?k=earbuds&page=2", "ok"), (None, "bad-type"), ("#", "empty"), ("javascript:x", "javascript"), ("mailto:a@b", "scheme"), ("ftp://amazon.in/s?k=a", "protocol"), ("https://x.com/s?k=a", "off-amazon"),
        ("/dp/B0ABCDEF12", "product-link"), ("/product-reviews/x?k=a", "review-link"), ("/gp/cart?ref=1", "account-link"), ("/about", "not-search-page"), ("https://amazon.com/s?k=earbuds", "host-changed"), ("/s?k=other", "query-changed"),
    ])


def test_queries(spark):
    pairs = [("  Wireless   AIRPODS!! ", "wireless airpods"), ("wireless earbuds under 1500", "wireless earbuds"), ("earbuds below rs 2000", "earbuds"), ("iphone 15", "iphone 15"), ("ear buds", "ear buds"), ("bear buds", "earbuds"), (None, "")]
    check(spark, text.normalize_query, pairs)
    assert [text.Query.of(raw).text for raw, _ in pairs] == [out for _, out in pairs]
    assert text.Query.of("between 500 and 1000").tokens == ("1000",)


RELEVANCE = [
    ("Wireless AirPods Pro", "wireless airpods", "HIGH"), ("AirPods Case Cover", "wireless airpods", "LOW"), ("USB Charging Cable", "wireless airpods", "LOW"), ("Premium AirPods Case Cover", "airpods case", "HIGH"),
    ("USB C Charging Cable", "usb c cable", "HIGH"), ("boAt Airdopes 141 Wireless Earbuds", "wireless airpods", "HIGH"), ("Noise Wireless Earbuds", "wireless airpods", "HIGH"),
    ("Wireless Bluetooth Earbuds", "wireless earbuds under 1500", "HIGH"), ("Earbuds Carrying Case", "wireless earbuds under 1500", "LOW"), ("Apple AirPods Case", "airpods case", "HIGH"),
    ("Kratos TW02 Ear Buds Wireless with 60H Playtime Earbuds Bluetooth TWS", "airpods", "HIGH"), ("AirPods Case Cover", "airpods", "LOW"), ("Kratos Ear Buds", "airpods", "HIGH"), ("anything", "", "UNKNOWN"), ("", "airpods", "UNKNOWN"),
]


@pytest.mark.parametrize(("title", "query", "category"), RELEVANCE)
def test_relevance(spark, title, query, category):
    row = text.with_relevance(spark.createDataFrame([(title,)], "title string"), query).first()
    assert row.relevance.category == category


def test_formatting(spark):
    check(spark, formatting.rupees, [(999.0, "₹999"), (1099.0, "₹1,099"), (129999.0, "₹1,29,999"), (1099.5, "₹1,099.5"), (None, None)], "double")
    check(spark, formatting.indian_digits, [(92431, "92,431"), (12345678, "1,23,45,678"), (0, "0")], "bigint")
    check(spark, formatting.rating_text, [(4.1, "4.1 average rating"), (0.0, None), (None, None)], "double")
    none = F.lit(None).cast("double")
    header = [formatting.header_text(F.lit(3), F.lit(600), F.lit(1500), F.lit(False)), formatting.header_text(F.lit(2), none, none, F.lit(False)), formatting.header_text(F.lit(8), none, none, F.lit(True))]
    assert tuple(spark.range(1).select(*header).first()) == ("3 PRODUCTS IN ₹600 – ₹1,500", "2 PRODUCTS FOUND", "8 RELEVANT PRODUCTS FOUND")
    counts = [formatting.count_text(F.lit(24532), none), formatting.count_text(F.lit(1234), none, F.lit("reviews")), formatting.count_text(F.lit(0), none)]
    assert tuple(spark.range(1).select(*counts).first()) == ("24,532 customer feedback", "1,234 customer reviews", None)
    check(spark, formatting.safe_message, [("No products found on this page.", "No products found on this page."), ("TypeError", "Something went wrong while analyzing this page. Please refresh and try again.")])


def test_insights(spark):
    used = [insights.budget_utilization(F.lit(a).cast("double"), F.lit(b).cast("double")) for a, b in ((999, 1500), (999, 0), (None, 5), (5, -1))]
    assert tuple(spark.range(1).select(*used).first()) == (66.6, None, None, None)
    for prices, want in (([999, 1299, 1499], (3, 999, 1499, 1266)), ([699, 999, 1499], (3, 699, 1499, 1066)), ([999, None, 1299], (2, 999, 1299, 1149)), ([999, float("nan"), -50, float("inf")], (1, 999, 999, 999)), ([None], (0, None, None, None))):
        row = insights.price_stats(spark.createDataFrame([(None if p is None else float(p),) for p in prices], "price double")).first()
        assert (row.valid_count, row.lowest, row.highest, row.average) == want
    stats = spark.createDataFrame([(699.0, 1066.0, True)], "lowest double, average double, has_prices boolean")
    got = insights.with_position(spark.createDataFrame([(699.0,), (916.0,), (1266.0,), (None,)], "price double"), stats).collect()
    assert sorted((str(r.price), r.position.type, r.position.diff) for r in got) == sorted([("699.0", "lowest", 0), ("916.0", "below", 150), ("1266.0", "above", 200), ("None", None, None)])


def test_pages(spark):
    got = spark.createDataFrame([(n,) for n in (0, 4, 5, 8, 9, 12, 13)], "n int").select(ranking.page_count(F.col("n"), F.lit(4)).alias("p")).collect()
    assert [r.p for r in got] == [0, 1, 2, 2, 3, 3, 4]
    got = spark.createDataFrame([(p,) for p in (1, 2, 3, 4, 0, -1)], "p int").select(ranking.page_range(F.col("p"), F.lit(12), F.lit(4)).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [(1, 4, 12), (5, 8, 12), (9, 12, 12), (0, 0, 12), (0, 0, 12), (0, 0, 12)]


def test_budget(spark):
    pairs = [("", ""), ("₹1,000", "2000"), ("500abc", ""), ("abc", ""), ("-1", ""), ("", "x"), ("9", "5")]
    got = spark.createDataFrame(pairs, "a string, b string").select(filters.budget(F.col("a"), F.col("b")).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [
        (None, None, None), (1000, 2000, None), (500, None, None), (None, None, "Please enter a valid minimum price."), (None, None, "Please enter a valid minimum price."),
        (None, None, "Please enter a valid maximum price."), (None, None, "Minimum price cannot be greater than maximum price."),
    ]


def test_pins(spark):
    check(spark, round_half_up, [(-0.5, 0), (0.5, 1), (2.5, 3)], "double")
    check(spark, leading_number, [("500abc", 500), (" 1.5e2x", 150), ("abc", None)])
    check(spark, squeeze, [("  a \t﻿ b\n", "a b")])
    check(spark, decoded, [("a+b%20c", "a b c"), ("50%", "50%")])


@pytest.mark.parametrize("function", [urls.canonical_page_of_site, urls.canonical_page_decoded, urls.product_url])
def test_urls_are_worked_out_once(spark, function):
    """No part of a URL is written out for every use of it."""
    plan = spark.createDataFrame([("a",)], "u string").select(function(F.col("u")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_") + plan.count("RLIKE") < 40, len(plan)


def test_odd_urls(spark):
    check(spark, urls.canonical_page_of_site, [
        (None, ""), (" # ", ""), ("", ""), ("#x", "https://www.amazon.in/"), ("HTTPS://A.b:443", "https://a.b/"), ("http://a.b:443/c/?", "http://a.b:443/c"), ("http://a.b:80//", "http://a.b/"),
        ("https://a.b/c d/?y=2&x=1&x=1&qid=3#z", "https://a.b/c%20d?x=1&y=2"), ("mailto:x#y", "mailto:x"), ("/s?k=%zz&ref=1", "https://www.amazon.in/s?k=%zz"), ("?k=1", "https://www.amazon.in/?k=1"),
    ])
    check(spark, urls.product_url, [(None, None), ("", None), ("/", ""), ("http:x?y", "http:x"), ("/dp/b0abcdefgh?x", "https://www.amazon.in/dp/B0ABCDEFGH"), ("https://a.b", ""), ("/x//ref=y", "/x")])
