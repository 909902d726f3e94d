from pyspark.sql import functions as F

from quern.functions import display
from quern.operators import records


def values(spark, column, *given):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


def test_labels(spark):
    assert values(spark, lambda h: display.brand_of_host(h)["name"], "www.aqua-di_roma.com") == ["Aqua Di Roma"]
    assert values(spark, lambda h: display.brand_of_folder(h)["slug"], "my_shop_com") == ["my-shop-com"]
    assert values(spark, display.stockist, "https://www.shop.co.uk/p", "no url", None) == ["Shop", "Stockist", "Stockist"]
    assert values(spark, lambda e: display.username(F.lit("a"), F.substring_index(e, "@", 1)), "Jo.Doe@x.com", "a@x") == ["jo_doe", None]
    assert values(spark, lambda c: display.price_label(F.lit(123450), c), None, "EUR", "CHF") == ["£1,234.50", "€1,234.50", "CHF 1,234.50"]
    assert values(spark, lambda u: display.size_label(F.lit(200.0), u, F.lit(190)), "ml", None) == ["200ml", "190g"]
    assert values(spark, display.image_url, "//a.com/{Width}x{height}.png", "ftp://a", "x") == ["https://a.com/1024x1024.png", None, None]
    assert values(spark, display.image_type_of_url, "a.WEBP?x", "a.jpeg", "a") == ["image/webp", "image/jpeg", None]
    assert values(spark, lambda r: F.try_variant_get(display.json_in(r), "$.a", "int"), '{"a":1}', '```json\n{"a":2}\n```', 'so {"a":3} ok', "none") == [1, 2, 3, None]


def test_group_variants(spark):
    rows = [(0, "https://a.com/p/x", None), (1, "https://a.com/p/x?v=2", "a.com/p/x"), (2, "https://a.com/p/y?v=1", "a.com/p/y"), (3, "https://a.com/p/y?v=2", "a.com/p/y"), (4, "https://a.com/p/z", None)]
    got = {r.place: len(r.variants) for r in records.group_variants(spark.createDataFrame(rows, "place int, url string, variant_of string")).collect()}
    assert got == {0: 1, 2: 1, 4: 0}


def test_prefer_and_prune(spark):
    kind = "id int, name string, n int, sizes array<int>"
    a, b = spark.createDataFrame([(1, "", None, []), (2, "x", 1, [1])], kind), spark.createDataFrame([(1, "y", 2, [3])], kind)
    assert {tuple(map(str, r)) for r in records.prefer(a, b, "id", ["sizes"]).collect()} == {("1", "y", "2", "[3]"), ("2", "x", "1", "[1]")}
    products = spark.createDataFrame([("u1", ["products/a/1.png"]), ("u2", ["products/b/1.png"]), ("u3", [])], "url string, files array<string>")
    gone = spark.createDataFrame([("u3", "c"), (None, "a")], "url string, slug string")
    assert [r.url for r in records.prune(products, gone).collect()] == ["u2"]


def test_missing_and_rules(spark):
    df = spark.createDataFrame([("short", None, "soy wax in a glass, burn time: 40 hours")], "d string, w string, t string")
    (r,) = df.select(records.missing_fields(F.col("d"), wax_type=F.col("w"), text=F.col("t")).alias("m"), records.rule_fields(F.col("t")).alias("f")).collect()
    assert r.m == ["description", "wax_type"] and (r.f.wax_type, r.f.vessel_material, r.f.burn_time_hours) == ("soy", "glass", 40)


def test_complete_isolates_failures(spark):
    df = spark.createDataFrame([("a",)], "prompt string")
    assert [r.reply for r in records.complete(df, lambda xs: [x * 2 for x in xs]).collect()] == ["aa"]
    assert [r.reply for r in records.complete(df, lambda xs: 1 / 0).collect()] == [None]


def test_natural_key(spark):
    from quern.operators.catalogue import natural_key

    names = ["item 10", "Item 9", "item 09b", "a", "item"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r.x for r in df.orderBy(natural_key(F.col("x"))).collect()] == ["a", "item", "Item 9", "item 09b", "item 10"]


def test_once_and_strays(spark, tmp_path):
    from quern.streaming import votes

    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "k int, t string").selectExpr("k", "cast(t as timestamp) ts")
    rows.write.parquet(str(tmp_path / "r"))
    stream = votes.strays(votes.once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "r")), ["k"]), spark.createDataFrame([(2,)], "k int"), "k")
    run = stream.writeStream.format("memory").queryName("strays").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.k for r in spark.table("strays").collect()] == [1]
