"""Storefront records on small rows: missing and odd fields, broken JSON, merges that keep the page's own."""

import json

from pyspark.sql import functions as F

from quern.operators import storefront as s

FULL = {
    "title": "Fig", "handle": "fig", "vendor": "Acre", "product_type": "Candle", "tags": ["a", "b"], "images": [{"src": "u1"}, {"src": None}, {}, {"src": ""}, {"src": "u2"}],
    "body_html": "<style>p{}</style><p>One &amp; two</p>\n\n<div>three<BR/>four</div>&nbsp;", "options": [{"name": "Size", "values": ["S", 2]}, {"name": "", "values": ["x"]}, {"name": "None", "values": []}, {"name": "Wax", "values": ["soy"]}],
    "variants": [
        {"id": 7, "title": "Default Title", "option1": "Default Title", "option2": "Oak", "sku": 123, "price": "12.50", "available": True},
        {"title": None, "option1": "", "sku": "", "price": "", "available": None}, {"id": "x", "title": "200g", "sku": "k", "price": 9, "available": False},
    ],
}


def read(spark, *rows, currency="EUR", **more):
    df = spark.createDataFrame([(i, None if r is None else r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "id long, json string")
    return s.records(df, "json", F.lit("https://h.test"), F.lit(currency).cast("string"), **more).orderBy("id").collect()


def test_a_full_product(spark):
    r = read(spark, FULL)[0]
    assert (r.source_url, r.name, r.brand, r.sku, r.images) == ("https://h.test/products/fig", "Fig", "Acre", "123", ["u1", "u2"])
    assert [tuple(o) for o in r.offers] == [
        ("12.50", "EUR", s.IN_STOCK, "123", "https://h.test/products/fig?variant=7", "Oak"), ("", "EUR", s.OUT_OF_STOCK, None, "https://h.test/products/fig?variant=None", None),
        ("9", "EUR", s.OUT_OF_STOCK, "k", "https://h.test/products/fig?variant=x", "200g"),
    ]
    assert r.description == "One & two\n\n three\nfour"  # the opening tag is a blank
    assert r.text == "Fig\nOne & two\n\n three\nfour\nType: Candle\nSize: S, 2\nWax: soy\nVariants: Oak 12.50 EUR (in stock); Default  (out of stock); 200g 9 EUR (out of stock)\nTags: a, b"
    assert "12.50 None (in stock)" in read(spark, FULL, currency=None)[0].text and read(spark, FULL, chars=5)[0].text == "Fig\nO"


def test_missing_fields_and_broken_json(spark):
    empty, null, broken, odd = read(spark, {}, None, "{oops", {"handle": "h", "title": "T", "variants": "none", "images": [1], "tags": "a,b"})
    for r in (empty, null, broken):
        assert (r.source_url, r.name, r.brand, r.sku, r.images, r.offers, r.description, r.text) == ("https://h.test/products/", None, None, None, [], [], "", "")
    assert (odd.name, odd.offers, odd.images, odd.text) == ("T", [], [], "T") and read(spark) == []


def test_a_very_long_text_is_read_whole(spark):
    r = read(spark, {"title": "T", "body_html": "<p>" + "word " * 100_000 + "end</p>"}, chars=None)[0]
    assert len(r.description) == 500_003 and r.text.endswith("word end")


def test_merge_completes_pages(spark):
    api = s.records(spark.createDataFrame([("a", json.dumps(FULL)), ("b", json.dumps({"title": "B", "images": [{"src": "u"}]}))], "key string, json string"), "json", F.lit("https://h.test"), F.lit("EUR"))
    offer = api.schema["offers"].dataType
    pages = spark.createDataFrame([("a", "https://p.test/a", "", "old", ["p"], None, 1), ("b", "https://p.test/b", "Own", "own", ["p", "q"], [("1", "GBP", None, None, "u", None)], 2), ("c", None, None, None, None, None, 3)], "key string, source_url string, name string, sku string, images array<string>, offers " + offer.simpleString() + ", extra int")
    got = {r.key: r for r in s.merged(pages, api, "key").collect()}
    assert (got["a"].name, got["a"].sku, got["a"].images, got["a"].extra) == ("Fig", "123", ["u1", "u2"], 1)
    assert [o.url for o in got["a"].offers] == ["https://p.test/a?variant=7", "https://p.test/a?variant=None", "https://p.test/a?variant=x"]
    assert (got["b"].name, got["b"].sku, got["b"].images, got["b"].offers[0].url) == ("Own", "own", ["p", "q"], "u")
    assert (got["c"].name, got["c"].sku, got["c"].images, got["c"].offers) == (None, None, None, None)


def test_endpoints(spark):
    cases = {"https://h.test/collections/candles/products/x": "/collections/candles", "https://h.test/en/collections/wax?x=1": "/collections/wax", "https://h.test/collections/All": "", "https://h.test/collections": "", "https://h.test/collections/": "", "https://h.test/": "", "https://h.test/pages?x=/collections/a": "", "https://h.test/mycollections/a": ""}
    got = spark.createDataFrame(list(cases.items()), "url string, want string").select(s.endpoint(F.lit("o"), F.col("url")).alias("e"), "want", "url").collect()
    assert [(r.url, r.e) for r in got] == [(r.url, f"o{r.want}/products.json") for r in got]
