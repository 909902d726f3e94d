"""Queries of record handling and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import display
from ..operators import catalogue as c
from ..operators import records
from . import model as m
from .queries import query


@query("""SELECT s_suppkey AS id, 'Supplier ' || s_suppkey AS brand_name, 'supplier-' || s_suppkey AS brand_slug, 'Shop' || s_suppkey AS stockist FROM supplier""")
def host_brands(spark, d):
    k = F.col("s_suppkey").cast("string")
    brand = display.brand_of_host(F.concat(F.lit("www.supplier-"), k, F.lit(".co.uk")))
    shop = display.stockist(F.concat(F.lit("https://www.shop"), k, F.lit(".com/p?q=1")))
    return m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), brand["name"].alias("brand_name"), brand["slug"].alias("brand_slug"), shop.alias("stockist"))


@query("""SELECT order_id, line, '£' || CASE WHEN price % 100 = 0 THEN format('{:,}', price // 100) ELSE format('{:,}', price // 100) || '.' || lpad((price % 100)::VARCHAR, 2, '0') END AS price, grams || 'g' AS size FROM sizes""")
def price_labels(spark, d):
    none = F.lit(None).cast("string")
    return m.sizes(spark, d).select("order_id", "line", display.price_label(F.col("price"), none).alias("price"), display.size_label(none.cast("double"), none, F.col("grams")).alias("size"))


@query("""SELECT order_id, line, n FROM (SELECT order_id, line, count(*) OVER (PARTITION BY order_id) - 1 AS total, row_number() OVER (PARTITION BY order_id ORDER BY line) AS r, CASE WHEN r = 1 THEN total ELSE 0 END AS n FROM (SELECT DISTINCT order_id, line FROM sizes)) WHERE r = 1""")
def variant_groups(spark, d):
    s = m.sizes(spark, d).select("order_id", "line").distinct()
    first = F.min("line").over(Window.partitionBy("order_id"))
    url = F.concat(F.lit("https://a.com/p/"), F.col("order_id").cast("string"))
    r = s.withColumn("first", first).select((F.col("order_id") * 100 + F.col("line")).alias("place"), F.concat(url, F.when(F.col("line") == F.col("first"), "").otherwise(F.concat(F.lit("?v="), F.col("line").cast("string")))).alias("url"), F.when(F.col("line") != F.col("first"), F.concat(F.lit("a.com/p/"), F.col("order_id").cast("string"))).alias("variant_of"))
    return records.group_variants(r).select(F.floor(F.col("place") / 100).alias("order_id"), (F.col("place") % 100).cast("int").alias("line"), F.size("variants").cast("long").alias("n"))


@query("""SELECT event_type AS field, list_aggregate(list_sort(list(DISTINCT user_id % 7)), 'string_agg', '|') AS parents, bool_or(event_id % 1000 = 0) AS also FROM events WHERE event_id % 3 <> 0 GROUP BY 1""")
def derived_sources(spark, d):
    e = m.table(spark, d, "events").select(F.col("event_type").alias("field"), (F.col("user_id") % 7).cast("string").alias("parent"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("x").alias("value"), F.when(F.col("event_id") % 1000 == 0, "also").otherwise("sometimes").alias("confidence"))
    return records.derived_sources(e).select("field", F.array_join("parents", "|").alias("parents"), "also")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def variant_fields(spark, d):
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return m.table(spark, d, "events").select("event_id", F.try_variant_get(display.json_in(reply), "$.k", "long").alias("k"))


@query("""SELECT CASE d WHEN 'act' THEN 1 ELSE 2 END AS place, d AS dimension, o AS sort_order, x AS option, coalesce(n, 0) AS n, (sum(coalesce(n, 0)) OVER (PARTITION BY d))::BIGINT AS total,
CASE WHEN sum(coalesce(n, 0)) OVER (PARTITION BY d) = 0 THEN 0 ELSE floor(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY d) + 0.5)::INT END AS pct
FROM (VALUES ('act', 0, 'click'), ('act', 1, 'purchase'), ('act', 2, 'gift'), ('never', 0, 'none')) AS c(d, o, x) LEFT JOIN (SELECT option, sum(votes)::BIGINT AS n FROM counts GROUP BY 1) ON x = option""")
def community_dimensions(spark, d):
    counts = c.vote_counts(c.latest(m.votes(spark, d), ["user_id", "product_id"], [F.col("ts").desc(), F.col("vote_id").desc()])).groupBy("option").agg(F.sum("votes").alias("n")).withColumn("dimension", F.lit("act"))
    catalog = spark.createDataFrame([("act", 0, "click"), ("act", 1, "purchase"), ("act", 2, "gift"), ("never", 0, "none"), ("hidden", 0, "view")], "dimension string, sort_order int, option string")
    return c.community(catalog, counts, ["act", "never"])


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey)::INT AS place FROM supplier")
def natural_order(spark, d):
    s = m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Shop "), F.col("s_suppkey").cast("string")).alias("name"))
    return c.ranked(s, "name", "id").select("id", "place")
