"""Storefront records as queries: parts and their line items written as API products, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import storefront as s
from . import model as m
from .queries import query

_ROWS = """, v AS (SELECT product_id, order_id, line, order_id * 10 + line AS id, CASE line % 3 WHEN 0 THEN 'Default Title' WHEN 1 THEN grams || 'g' ELSE '' END AS title, CASE WHEN line % 2 = 0 THEN 'Default Title' ELSE 'Opt ' || line END AS option1,
  CASE WHEN order_id % 4 > 1 THEN 'S' || order_id END AS sku, CASE WHEN order_id % 9 > 0 THEN (price // 100) || '.' || lpad((price % 100)::VARCHAR, 2, '0') END AS price, order_id % 2 = 0 AS available FROM sizes),
o AS (SELECT *, coalesce(CASE WHEN title NOT IN ('', 'Default Title') THEN title END, CASE WHEN option1 <> 'Default Title' THEN option1 END) AS size FROM v),
w AS (SELECT product_id, string_agg(concat_ws(' ', price, CASE WHEN product_id % 2 = 0 THEN 'EUR' END, CASE WHEN available THEN 'https://schema.org/InStock' ELSE 'https://schema.org/OutOfStock' END, sku, '{0}?variant=' || id, size), ',' ORDER BY order_id, line, title, option1, price NULLS FIRST) AS offers,
  string_agg(trim(coalesce(size, 'Default') || ' ' || coalesce(price || ' ' || CASE WHEN product_id % 2 = 0 THEN 'EUR' ELSE 'None' END, '') || ' (' || CASE WHEN available THEN 'in stock' ELSE 'out of stock' END || ')'), '; ' ORDER BY order_id, line, title, option1, price NULLS FIRST) AS told, arg_min(coalesce(sku, ''), (order_id, line)) AS sku FROM o GROUP BY 1),
r AS (SELECT product_id, 'https://shop.test/products/p-' || product_id AS source_url, CASE WHEN product_id % 17 > 0 THEN name END AS name, 'About & ' || name || chr(10) || ' end' AS description, brand, nullif(w.sku, '') AS sku,
  array_to_string(['https://cdn.test/' || product_id || '/' || i FOR i IN range(product_id % 3 + 1)], ',') AS images, product_id % 3 + 1 AS n_images, coalesce(offers, '') AS offers,
  concat_ws(chr(10), CASE WHEN product_id % 17 > 0 THEN name END, 'About & ' || name || chr(10) || ' end', CASE WHEN product_id % 2 = 0 THEN 'Type: ' || category_slug END, CASE WHEN product_id % 3 = 0 THEN 'Size: a, b' END, 'Variants: ' || told, CASE WHEN product_id % 4 > 0 THEN 'Tags: t' || product_id % 4 || ', candle' END) AS text FROM products LEFT JOIN w USING (product_id))"""


def _api(spark, d):
    """product_id, json: parts as products of a shop's API."""
    k, order, line = F.col("product_id"), F.col("order_id"), F.col("line")
    lone, cents = F.lit("Default Title"), F.col("price")
    variant = F.struct(
        order, line, (order * 10 + line).alias("id"), F.when(line % 3 == 0, lone).when(line % 3 == 1, F.concat(F.col("grams").cast("string"), F.lit("g"))).otherwise("").alias("title"), F.when(line % 2 == 0, lone).otherwise(F.concat(F.lit("Opt "), line.cast("string"))).alias("option1"),
        F.when(order % 4 > 1, F.concat(F.lit("S"), order.cast("string"))).when(order % 4 == 1, "").alias("sku"), F.when(order % 9 > 0, F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))).alias("price"), (order % 2 == 0).alias("available"),
    )
    variants = m.sizes(spark, d).groupBy("product_id").agg(F.array_sort(F.collect_list(variant)).alias("variants"))
    sources = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("https://cdn.test/"), k.cast("string"), F.lit("/"), i.cast("string")).alias("src")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("src")))
    product = F.struct(
        F.when(k % 17 > 0, F.col("name")).alias("title"), F.concat(F.lit("p-"), k.cast("string")).alias("handle"), F.col("brand").alias("vendor"), F.concat(F.lit("<p>About &amp;  "), "name", F.lit("</P><script>x</script><b>end</b><br/>")).alias("body_html"),
        F.when(k % 2 == 0, F.col("category_slug")).alias("product_type"), F.when(k % 4 > 0, F.array(F.concat(F.lit("t"), (k % 4).cast("string")), F.lit("candle"))).otherwise(F.array()).alias("tags"), F.concat(sources, none).alias("images"),
        F.when(k % 3 == 0, F.array(F.struct(F.lit("Size").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("values")))).alias("options"), "variants",
    )
    return m.products(spark, d).join(variants, "product_id", "left").select("product_id", F.to_json(product).alias("json"))


def _told(offers):
    return F.array_join(F.transform(offers, lambda o: F.concat_ws(" ", *[o[f] for f in ("price", "currency", "availability", "sku", "url", "size")])), ",")


def _records(spark, d):
    return s.records(_api(spark, d), "json", F.lit("https://shop.test"), F.when(F.col("product_id") % 2 == 0, "EUR"))


@query(_ROWS + " SELECT product_id, source_url, name, description, brand, sku, images, replace(offers, '{0}', source_url) AS offers, text FROM r")
def storefront_records(spark, d):
    return _records(spark, d).withColumn("offers", _told("offers")).withColumn("images", F.array_join("images", ","))


@query(_ROWS + """ SELECT product_id, 'https://page.test/' || product_id AS source_url, CASE WHEN product_id % 5 = 0 AND product_id % 7 > 0 AND name IS NOT NULL THEN name WHEN product_id % 5 = 0 THEN '' ELSE 'Page ' || product_id END AS name, CASE WHEN product_id % 7 > 0 THEN coalesce(sku, 'own') ELSE 'own' END AS sku,
CASE WHEN product_id % 7 > 0 AND n_images > product_id % 4 THEN images ELSE array_to_string(['own ' || i FOR i IN range(1, product_id % 4 + 1)], ',') END AS images, CASE WHEN product_id % 7 > 0 AND offers <> '' THEN replace(offers, '{0}', 'https://page.test/' || product_id) ELSE '' END AS offers FROM r""")
def storefront_merged(spark, d):
    """Pages of every product, those with a record of the API (6 of 7) completed by it."""
    k = F.col("product_id")
    api = _records(spark, d).filter(k % 7 > 0)
    own = F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), (k % 4).cast("int")), lambda i: F.concat(F.lit("own "), i.cast("string")))
    pages = m.products(spark, d).select(k, F.concat(F.lit("https://page.test/"), k.cast("string")).alias("source_url"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Page "), k.cast("string"))).alias("name"), F.lit("own").alias("sku"), own.alias("images"), F.lit(None).cast(api.schema["offers"].dataType).alias("offers"))
    full = s.merged(pages, api, "product_id")
    return full.select("product_id", "source_url", "name", "sku", F.array_join("images", ",").alias("images"), F.coalesce(_told("offers"), F.lit("")).alias("offers"))
