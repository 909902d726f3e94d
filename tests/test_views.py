"""Product views, url keys and labels on small rows: nulls, ties and empty tables."""

import hashlib

from pyspark.sql import functions as F

from quern.functions import labels, urls
from quern.operators import catalogue as c
from quern.operators import views as v


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filters_from_parameters():
    f = c.filters_of({"notes": "a, ,b", "accords": "", "vote_options": "x", "min_rating": "3.5", "limit": "5"})
    assert (f.notes, f.accords, f.votes, f.min_rating, f.limit, f.offset, f.sort, f.brand) == (["a", "b"], [], ["x"], 3.5, 5, 0, "name", None)


def test_url_rules(spark):
    key = {"http://A.org/x/?b=2&a=1#f": "http://a.org/x?a=1&b=2", "http://a.org/%C3%A9+b/": "http://a.org/%C3%A9+b", "http://a.org/100%": "http://a.org/100%", "http://a.org/?": "http://a.org", "http://a.org/?q=a%26b=1": "http://a.org?q=a&b=1", "HTTPS://a.org:443/a/../b?x=1+2&x=0&a%3D": "https://a.org/b?a==&x=1 2&x=0", "a b": "a b"}
    for url, want in key.items():
        assert one(spark, urls.url_key(F.lit(url))) == want
    base = F.lit("https://h.org/p/q?a=/b")
    links = {"p": None, "/p": "https://h.org/p", "//c.org/p": "https://c.org/p", "javascript:x": None, " ": None, "HTTP://q.org": None, "../x": None, "?page=2": None, "ftp://z/x": None, "/a/../b/./c?d#e": "https://h.org/b/c?d", "/../..": "https://h.org/", "http://z.org/a/../b#c": "http://z.org/a/../b", "httpx": "https://h.org/p/httpx", "#x": None, "http:x": None}
    assert {u: one(spark, urls.absolute(F.lit(u), base)) for u in links} == links
    assert one(spark, urls.page_filename(F.lit("//"))).startswith("page-") and one(spark, urls.page_filename(F.lit("a.org/b"))) == "a-org-b-" + hashlib.sha1(b"a.org/b").hexdigest()[:10] + ".html"
    short = {"http://a.org": "a.org", "http://u@A.org:8080/?x": "a.org", "http://a.org/a+b%20c/": "a+b c", "http://a.org/%zz": "http://a.org/%zz", "x" * 50: "x" * 40}
    assert {u: one(spark, urls.short_url(F.lit(u))) for u in short} == short
    assert not one(spark, urls.same_authority(F.lit("http://www.a.org"), F.lit("http://a.org"))) and one(spark, urls.same_host(F.lit("http://www.a.org"), F.lit("http://A.org")))
    assert [one(spark, urls.safe_segment(F.lit(x))) for x in ("a", "", ".", "..", "a/b", "a\\b", None)] == [True, False, False, False, False, False, False]
    assert one(spark, urls.matches_any(F.lit("https://a.org/Cart/1"), ["^/cart", "/login"])) and one(spark, urls.short_url(F.lit("http://a.org/b/c%20d/?q"))) == "c d"


def test_labels(spark):
    assert one(spark, labels.whole_minor_units(F.lit(1299), F.lit("GBP"), F.lit(-1).cast("long"))) == 1299
    assert one(spark, labels.whole_minor_units(F.lit(99), F.lit("GBP"), F.lit(9900).cast("long"))) == 9900
    assert one(spark, labels.whole_minor_units(F.lit("12.50"), F.lit("GBP"), F.lit(1250).cast("long"))) == 1250
    assert one(spark, labels.plain_price(F.lit(123456))) == "£1234.56" and one(spark, labels.plain_price(F.lit(None).cast("long"))) is None
    assert one(spark, labels.joined_values(F.array(F.lit(" "), F.lit(""), F.lit("b ")))) == " \nb " and one(spark, labels.joined_values(F.array().cast("array<string>"))) == ""
    assert one(spark, labels.type_value(F.lit(" A  12\tb"))) == "a # b" and one(spark, labels.long_enough(F.lit("short"), F.lit(" "))) == "short"
    assert one(spark, labels.first_text(F.lit(" "), F.array(F.lit(""), F.lit(" b ")))) == " b " and one(spark, labels.listed(F.lit(None).cast("string"))) == []


def test_bars_stages_and_lines(spark):
    bars = F.from_json(F.lit('[{"name":"a"},{"name":"b","pct":5},{"name":"c","pct":9},{"name":"d","pct":5}]'), "array<struct<name string, pct int>>")
    assert [x["name"] for x in one(spark, v.accord_bars(bars))] == ["c", "b", "d", "a"]
    assert [one(spark, v.stage_name(F.lit(s))) for s in ("Heart", None, "odd", "base")] == ["middle", "general", "Notes", "base"]
    assert one(spark, v.collapse_lines(F.lit(" a \na\n\na\nb\na"), 4)) == "a\nb\n" and one(spark, v.collapse_lines(F.lit(""), 4)) == ""


def test_rows(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "z")], "p int, k string")
    after, removed = v.replace_children(old, spark.createDataFrame([(1, "b"), (1, "c")], "p int, k string"), "p", "k")
    assert sorted(after.collect(), key=repr) == [(1, "b"), (1, "c"), (2, "a"), (None, "z")] and removed.collect() == [(1, "a")]
    rows = spark.createDataFrame([(1, "old"), (2, None), (3, "x")], "id int, email string")
    changed = v.guarded_update(rows, spark.createDataFrame([(1, "new"), (2, "new"), (3, "x")], "id int, email string"), "id", "email")
    assert sorted(changed.collect()) == [(1, "new", True), (2, None, False), (3, "x", False)]
    found = v.techniques([rows.select(F.col("email").alias("url")).filter("id = 1"), spark.createDataFrame([("old",), ("far",)], "url string"), rows.select(F.lit("late").alias("url"))], 2)
    assert sorted(found.collect()) == [("far", 1), ("old", 0)]
    none = spark.createDataFrame([], "product_id int, position int, note string, stage string")
    assert v.notes_by_stage(none).count() == 0 and v.first_per_key(none, ["note"], "position").count() == 0
