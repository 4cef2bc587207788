"""Expectation tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from offerlens.functions import page as G
from offerlens.functions import price as P
from offerlens.functions import text as X
from offerlens.functions import url as U
from offerlens.html import prices as R

AMOUNTS = [
    ("৳1,250.00", [1250.0]),
    ("Tk 99", [99.0]),
    ("1,299 - 1,599", [1299.0, 1599.0]),
    ("৳১,২৫০", [1250.0]),
    ("25% off 300", [300.0]),
    ("0", []),
    ("", []),
]
PRICE_TEXTS = [
    ("৳1,299", [1299.0]),
    ("1299 Tk", [1299.0]),
    ("1299Tk", []),  # a code must stand alone to mark a price
    ("Hoco EQ27 20mm", []),
    ("1,450", [1450.0]),
    ("Rs. 2,500 was Rs 3,000", [2500.0, 3000.0]),
    ("$29.99 or €31", [29.99, 31.0]),
]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("s"))).collect()]


def test_amounts(spark):
    texts = [t for t, _ in AMOUNTS]
    assert column(spark, texts, P.extract_amounts) == [a for _, a in AMOUNTS]
    assert [R.amounts(t) for t in texts] == [a for _, a in AMOUNTS]
    assert column(spark, texts, P.parse_price) == [min(a, default=None) for _, a in AMOUNTS]


def test_price_invariant(spark):
    texts = [t for t, _ in PRICE_TEXTS]
    assert column(spark, texts, P.amounts_from_price_text) == [a for _, a in PRICE_TEXTS]
    assert [R.price_amounts(t) for t in texts] == [a for _, a in PRICE_TEXTS]


def test_currency(spark):
    texts = ["৳5", "tk. 5", "$5", "5 usd", "€5", "5 GBP", "₹5", "Rs 5", "", None]
    want = ["BDT", "BDT", "USD", "USD", "EUR", "GBP", "INR", "BDT", "BDT", "BDT"]
    assert column(spark, texts, P.detect_currency) == want
    assert [R.currency(t) for t in texts] == want


def test_discount_and_rounding(spark):
    df = spark.createDataFrame([(900.0, 450.0), (100.0, 100.0), (None, 5.0), (200.0, 197.0), (0.0, 5.0)], "o double, d double")
    assert [r[0] for r in df.select(P.compute_discount("o", "d")).collect()] == [50, None, None, 2, None]
    df = spark.createDataFrame([(0.2125,), (0.2135,), (1.0,), (0.0005,), (2.9995,)], "x double")
    assert [r[0] for r in df.select(P.to_fixed(F.col("x"))).collect()] == ["%.3f" % x for x in (0.2125, 0.2135, 1.0, 0.0005, 2.9995)]



def test_fixed_decimals_of_exact_halves_go_to_even(spark):
    xs = [k / n for n in (16, 48, 67, 80) for k in range(n + 1)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(P.to_fixed(F.col("x"))).collect()] == ["%.3f" % x for x in xs]


def test_claims_badges_prices_shown(spark):
    html = ["<p>showing 24 of 1,234 products</p>", "<b>৳</b> 96 items found", "<script>of 5 products</script>none", None]
    assert column(spark, html, P.claimed_total) == [1234, 96, None, None]
    assert column(spark, ["-50% off", "save 7 %", "none"], P.badge_discount) == [50, 7, None]
    df = spark.createDataFrame([(1250.5, "BDT"), (1250.0, "USD"), (99.99, "AED")], "n double, c string")
    assert [r[0] for r in df.select(P.format_price("n", "c")).collect()] == ["৳1,250.5", "$1,250", "AED 99.99"]


def test_titles(spark):
    texts = ["Philips HD9285 (New) Pack of 2!", "ফ্রি  X688 কেটলি", "a b"]
    assert column(spark, texts, X.normalize_title)[0] == "philips hd9285 2"
    assert column(spark, ["philips hd9285 mini fan 5000 philips"], lambda c: X.model_tokens(X.content_tokens(c))) == [["hd9285", "5000"]]
    assert column(spark, ["flashSale-2026/Hot_Deals"], X.tokenize) == [["flash", "sale", "2026", "hot", "deals"]]
    assert column(spark, ["Crème  Brûlée ﬁn"], X.fingerprint_title) == ["creme brulee fin"]
    assert column(spark, ["a  ﻿b"], X.collapse) == ["a b"]


def test_dice(spark):
    df = spark.createDataFrame([("night", "nacht"), ("same", "same"), ("a", "b"), ("aaaa", "aa"), ("a b", "ab")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(X.dice("a", "b")).collect()] == [0.25, 1.0, 0.0, 0.5, 1.0]


CANONICAL = [
    ("https://Shop.Test:443//deals//?utm_source=x&page=2&Sort=a#top", "https://shop.test/deals?page=2&sort=a"),
    ("http://a.test/", "http://a.test/"),
    ("http://a.test", "http://a.test/"),
    ("http://a.test:8080/x/", "http://a.test:8080/x"),
    ("ftp://a.test/x", None),
    ("http://a.test/1/2/3/4/5/6/7", None),
    ("http://a.test/" + "x" * 600, None),
    ("http://a.test/?q=b&q=a&ref=z", "http://a.test/?q=b&q=a"),
]


def test_urls(spark):
    assert column(spark, [u for u, _ in CANONICAL], U.canonicalize) == [c for _, c in CANONICAL]
    hosts = ["pages.daraz.com.bd", "a.b.co.uk", "com.bd", "localhost", "10.0.0.1", "x.test.", "", None]
    assert column(spark, hosts, U.registrable_domain) == ["daraz.com.bd", "b.co.uk", None, None, None, "x.test", None, None]
    assert column(spark, ["https://www.daraz.com.bd/x", "https://shop.test", "no url"], U.site_name) == ["Daraz", "Shop", "Unknown"]
    assert column(spark, ["chaldal.com/deals", " https://A.test ", "localhost", ""], U.normalize_url) == ["https://chaldal.com/deals", "https://a.test/", None, None]
    urls = ["http://8.8.8.8/", "http://10.0.0.1/", "http://172.16.0.9/", "http://shop.test/", "ftp://shop.test/", "http://169.254.1.1/"]
    assert column(spark, urls, U.public_address) == [True, False, False, True, False, False]


@pytest.mark.parametrize(
    ("pattern", "url", "want"),
    [
        ("/deals", "https://a.test/Deals/", True),
        ("deals", "https://a.test/deals?sort=1", True),
        ("/shop/?on_sale=1", "https://a.test/shop/?on_sale=1", True),
        ("/shop/?on_sale=1", "https://a.test/shop/", False),
        ("/c/*/sale", "https://a.test/c/x/y/sale", True),
        ("https://a.test/*", "https://a.test/z", True),
        ("/a.b", "https://a.test/aXb", False),
        ("", "https://a.test/", False),
    ],
)
def test_patterns(spark, pattern, url, want):
    assert column(spark, [url], lambda c: U.matches_pattern(pattern, c)) == [want]


def test_keywords(spark):
    texts = ["wholesale buyers", "Flash Sale", "discuont", "black friday", "under", "", None]
    assert column(spark, texts, lambda c: G.keyword_score(c, 11)) == [0.0, 1.0, 0.0, 1.0, 0.45, 0.0, 0.0]
    assert column(spark, ["black friday", "promotiom"], lambda c: G.keyword_score(c, 3)) == [0.45, 1.0]
    assert column(spark, texts[:2], G.negative_token) == ["wholesale", None]


def test_block_phrases(spark):
    assert column(spark, ["<p>Access Denied</p>", "x" * 20_001 + "captcha"], G.detect_block) == ['challenge page ("Access Denied")', None]
