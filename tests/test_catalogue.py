from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quern.functions import numbers, text, urls
from quern.operators import catalogue as c
from quern.plans import auditing, labels, more, records, views, writing  # noqa: F401
from quern.plans import queries as plans
from quern.sources import files

SF = "/root/testdata/sf0.001"


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = plans.QUERIES[name](spark, SF), con.sql(plans.SQL[name])
    names = sorted(df.columns)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    got = sorted((rounded(r[n] for n in names) for r in df.collect()), key=repr)
    assert got == sorted((rounded(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 20


def values(spark, column, *given):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x")).alias("v")).collect()]


def test_text(spark):
    assert values(spark, text.slugify, "  Aqua di Roma! Été ", "", None) == ["aqua-di-roma-t", "", None]
    assert values(spark, text.slug_or_unknown, "!!") == ["unknown"]
    assert values(spark, text.host_slug, "www.My-Shop.com") == ["my_shop_com"]
    assert values(spark, text.host_core, "www.aqua.co.uk") == ["aqua"]
    assert values(spark, text.title_shouted, "ROSE  OUD de Mai") == ["Rose Oud de Mai"]
    assert values(spark, text.wax_type, "100% Soy Wax", "coconut  soy", "wool") == ["soy", "coconut-soy", None]
    assert values(spark, text.vessel_material, "in a glass", "Tin can", "nothing") == ["glass", "tin", None]
    assert values(spark, text.burn_time_hours, "Burn time: up to 40 hours", "x") == [40, None]
    assert values(spark, text.scent_summary, "Olfactive family: Woody amber. More", "x") == ["Woody amber", None]
    assert values(spark, text.brand_line, "12", "---", "12 Refine by Brand: Acme", "Acme (31)", " Acme ") == [None, None, "Acme", "Acme", "Acme"]
    assert values(spark, text.hex_color, "AABBCC", "#aabbcc", "red") == ["#aabbcc", "#aabbcc", None]
    assert values(spark, text.junk_name, "rose", "with the rose", "a.", "") == [False, True, True, True]
    assert values(spark, text.noisy_description, "short", None, "Add to cart " * 3 + "choose your size " * 3, "A calm and long description of a candle, by hand.") == [True, True, True, False]


def test_numbers(spark):
    assert values(spark, numbers.number_of, "1,234.5 g", "-2.5", "x") == [1235, -2, None]
    assert values(spark, numbers.currency_of, "125", "125.00", "$125") == [125.0, 12500.0, 12500.0]
    assert values(spark, numbers.minor_units, "1.234,50 €", "£12.345", "12,50", "1,234", "x") == [123450, 1234, 1250, 123400, None]
    assert [(r.value, r.unit, r.grams) for r in values(spark, numbers.size_of, "190g", "6.5 oz", "2 lbs", "100 ml")] == [(190.0, "g", 190), (6.5, "oz", 184), (2.0, "lb", 907), (100.0, "ml", None)]
    assert values(spark, numbers.availability, "https://schema.org/InStock", "out of stock", "soon", "") == ["InStock", "OutOfStock", "soon", None]


def test_urls(spark):
    assert values(spark, urls.product_key, "https://A.com/p/Rose Oud/", "http://a.com") == ["a.com/p/rose oud", "a.com"]
    assert values(spark, lambda u: urls.path_score(u, ["/products?/"]), "https://a.com/x/products/rose") == [3]


def test_unique_slugs(spark):
    rows = [(1, "s", "a", 1), (2, "s", "a", 2), (3, "s", "a-2", 3), (4, "s", "b", 4), (5, "t", "a", 5)]
    df = spark.createDataFrame(rows, "product_id int, site string, slug string, position int")
    got = {r.product_id: r.slug for r in c.unique_slugs(df).collect()}
    assert got == {1: "a-3", 2: "a-4", 3: "a-2", 4: "b", 5: "a"}


def test_unique_slugs_hot_and_null_site(spark):
    slugs = [("s", "a")] * 3000 + [("s", f"a-{n}") for n in [*range(2, 40), *range(100, 900, 7), 10**6]] + [("s", "a-02"), ("s", "a-1")]
    slugs += [(None, "a"), (None, "a"), (None, "a-2"), ("s", ""), ("s", ""), ("s", None), ("s", None)]
    df = spark.createDataFrame([(i, s, g, i * 7919 % 10007) for i, (s, g) in enumerate(slugs)], "product_id int, site string, slug string, position int")
    out = c.unique_slugs(df)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    want, often = {}, {x for x in slugs if x[1] and slugs.count(x) > 1}
    used = {x for x in slugs if x not in often}
    for i in sorted(range(len(slugs)), key=lambda i: i * 7919 % 10007):
        site, slug = want[i] = slugs[i]
        if (site, slug) in often:
            n = 2
            while (site, f"{slug}-{n}") in used:
                n += 1
            want[i] = site, f"{slug}-{n}"
            used.add(want[i])
    assert {r.product_id: (r.site, r.slug) for r in out.collect()} == want


def test_merge_keeps_and_replaces(spark):
    old = spark.createDataFrame([("k1", "o", 0), (None, "o", 0), ("k3", "o", 0)], "key string, v string, seq int")
    new = spark.createDataFrame([("k1", "n1", 1), ("k1", "n2", 2), (None, "n", 3), ("k4", "n", 4)], "key string, v string, seq int")
    assert sorted(((r.key or "", r.v) for r in c.merge(old, new, "key").collect())) == [("", "o"), ("k1", "n2"), ("k3", "o"), ("k4", "n")]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x"}')
    (tmp_path / "b.json").write_text("{bad")
    assert [r.name for r in files.read_documents(spark, str(tmp_path / "*.json"), "name string").collect()] == ["x"]
    assert files.read_lines(spark, str(tmp_path / "none"), files.FAILURES).count() == 0
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "i" / "b.png").write_bytes(b"text")
    assert sorted(str(r.content_type) for r in files.read_images(spark, str(tmp_path / "i")).collect()) == ["None", "image/png"]


def test_votes_stream_equals_batch(spark, tmp_path):
    from quern.plans import model
    from quern.streaming import votes

    model.votes(spark, SF).repartition(3).write.parquet(str(tmp_path / "votes"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "votes")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "votes"))
    run = votes.latest_votes(stream).writeStream.outputMode("complete").format("memory").queryName("latest_votes").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(spark.table("latest_votes").collect()) == sorted(plans.upsert_latest_vote(spark, SF).collect())
