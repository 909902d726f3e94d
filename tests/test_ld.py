"""JSON-LD at any depth; sizes of products, offers, variants and texts."""

import json

from pyspark.sql import functions as F

from quern.operators import ld, pages


def sizes(spark, product):
    row = spark.createDataFrame([(json.dumps(product),)], "j string").select(ld.sizes(F.parse_json("j"), F.lit("u")).alias("s")).first()
    return [(s.value, s.unit, s.grams, s.price, s.currency, s.sku, s.availability, s.source_url, s.is_primary) for s in row.s]


def test_sizes_of_products(spark):
    assert sizes(spark, {"size": "200g", "sku": "a", "offers": {"price": 1999, "priceCurrency": "EUR", "availability": "http://schema.org/OutOfStock", "url": "o"}}) == [(200.0, "g", 200, 1999, "EUR", "a", "OutOfStock", "o", True)]
    many = {"size": "", "offers": [{"price": "5.00"}, {"price": "6.50", "size": "1 lb", "priceCurrency": "USD"}, "no", {"price": "6.50", "size": "1lb"}], "isSimilarTo": {"price": "7"}, "model": [{"size": "2oz", "offers": [1]}, {"name": "bare"}]}
    assert sizes(spark, many) == [(None, None, None, 500, None, None, None, "u", True), (1.0, "lb", 454, 650, "USD", None, None, "u", False), (2.0, "oz", 57, None, None, None, None, "u", False)]
    assert sizes(spark, {}) == sizes(spark, {"offers": []}) == sizes(spark, []) == []


def test_sizes_in_text(spark):
    texts = {"Choose your size 200 g / 1KG, 200g 70ml": [("g", 200), ("kg", 1000), ("ml", None)], "Net WEIGHT: 7 oz, weight: 9 g": [("oz", 198)], "none": [], "choose your size big": []}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ld.sizes_in_text(F.col("t"), F.lit("EUR")).alias("s")).collect()
    assert {r.t: [(s.unit, s.grams) for s in r.s] for r in rows} == texts


def test_variant_offers(spark):
    rows = spark.createDataFrame([(json.dumps({"sku": "s", "size": "5 g", "offers": [{"price": 3, "priceCurrency": "EUR"}]}), "burn time: 40 hours", "x", ""), (None, "", "x", "y")], "j string, t string, sku string, size string")
    a, b = [r.o for r in rows.select(ld.variant_offer(F.parse_json("j"), F.col("t"), F.col("sku"), F.col("size"), F.lit("u")).alias("o")).collect()]
    assert (a.sku, a.size, a.price, a.currency, a.burn_time_hours, a.source_url) == ("s", "5 g", "3", "EUR", 40, "u") and (b.sku, b.size, b.price) == ("x", "y", None)


def test_products_beside_deep_values(spark):
    """A value nested thousands of levels deep costs neither the product beside it nor the one inside."""
    inner = '{"@type": "Product", "name": "inside, \\"}{\\" quoted"}'
    deep = '{"a": [' * 3000 + inner + "]}" * 3000
    html = lambda j: f'<script type="application/ld+json">{j}</script>'
    rows = [(1, html('[{"x": ' + deep + '}, {"@type": "Product", "name": "beside", "image": [[[["http://a"]]]]}]')), (2, html('{"@type": "Product", "name": "holder", "deep": ' + deep + "}")), (3, html(deep[:-1])), (4, html(deep))]
    nodes = pages.json_ld(spark.createDataFrame(rows, "page_id int, html string")).persist()
    names = {(r.page_id, r.name) for r in nodes.filter(F.try_variant_get("node", "$.name", "string").isNotNull()).select("page_id", F.try_variant_get("node", "$.name", "string").alias("name")).collect()}
    inside = 'inside, "}{" quoted'
    assert names == {(1, inside), (1, "beside"), (2, "holder"), (2, inside), (4, inside)}
    assert {(r.page_id, r.name) for r in pages.products(nodes).collect()} == {(1, inside), (2, "holder"), (4, inside)}
    small = ['[1, {"a": {"b": "}"}, "c": [{}, {"d": null}]}, {"e": -1.5e3}]', '{"a": "\\u00e9 \\" :,"}', "{}", "[]", "7"]
    for text in small:
        assert pages._flat(text) == pages._objects(text)


def test_sizes_parse_their_record_once(spark):
    """A record that is text is named once in the expression, not once for every field that is read."""
    assert str(ld.sizes(F.parse_json("j"), F.lit("u"))).count("parse_json(j)") == 1
    twice = {"size": "1 g", "offers": [{"size": "2 g"}, {"size": "1 g"}, {"size": "2 g", "price": "9"}]}
    assert [(s[0], s[3]) for s in sizes(spark, twice)] == [(1.0, None), (2.0, None)]
