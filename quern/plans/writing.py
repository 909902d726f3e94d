"""Queries of the write path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import writes
from . import model as m
from .queries import query


@query("SELECT product_id, CASE WHEN product_id % 4 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN product_id % 4 = 0 AND product_id % 8 = 0 THEN NULL ELSE size END AS size FROM products")
def patch_products(spark, d):
    p = m.products(spark, d).select("product_id", "name", "size")
    changes = p.filter("product_id % 4 = 0").select("product_id", F.upper("name").alias("name"), F.lit(True).alias("has_name"), F.lit(None).cast("int").alias("size"), (F.col("product_id") % 8 == 0).alias("has_size"))
    return writes.patch(p, changes, "product_id")


@query("""SELECT 'notes' AS name, count(*) AS n FROM notes WHERE product_id % 10 <> 3 UNION ALL SELECT 'products', count(*) FROM products WHERE product_id % 10 <> 3 UNION ALL SELECT 'sizes', count(*) FROM sizes WHERE product_id % 10 <> 3""")
def cascade_delete(spark, d):
    p = m.products(spark, d)
    gone = p.filter("product_id % 10 = 3").select(F.col("product_id").alias("id"))
    left = writes.cascade({"products": (p, "product_id"), "notes": (m.notes(spark, d), "product_id"), "sizes": (m.sizes(spark, d), "product_id")}, gone)
    parts = [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in left.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT user_id AS id, user_id IN (SELECT o_custkey FROM orders) AS found FROM (SELECT DISTINCT user_id FROM events)")
def bulk_delete_split(spark, d):
    return writes.split_ids(m.table(spark, d, "events").select(F.col("user_id").alias("id")), m.table(spark, d, "orders"), "o_custkey")


@query("SELECT note, CASE WHEN note LIKE 'b%' THEN '#111111' WHEN note LIKE 'c%' THEN '#222222' END AS color, note NOT LIKE 'b%' AS created FROM (SELECT DISTINCT note FROM notes WHERE note LIKE 'b%' OR note LIKE 'c%')")
def ensure_notes(spark, d):
    n = m.notes(spark, d).select("note").distinct()
    known = n.filter(F.col("note").startswith("b")).withColumn("color", F.lit("#111111"))
    wanted = n.filter(F.col("note").startswith("b") | F.col("note").startswith("c")).withColumn("color", F.lit("#222222"))
    return writes.ensure(known, wanted, "note", ["color"])


@query("SELECT user_id, product_id, count(*) AS n FROM reviews WHERE status <> 'rejected' GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, d):
    return writes.repeated_keys(m.reviews(spark, d), ["user_id", "product_id"], F.col("status") != "rejected")


@query("SELECT review_id FROM reviews WHERE product_id NOT IN (SELECT product_id FROM products WHERE product_id % 2 = 0)")
def foreign_key_violations(spark, d):
    parents = m.products(spark, d).filter("product_id % 2 = 0")
    return writes.orphans(m.reviews(spark, d), "product_id", parents, "product_id").select("review_id")


@query("SELECT review_id, CASE WHEN review_id % 5 = 0 THEN 'approved' ELSE status END AS status, review_id % 5 = 0 OR status = 'approved' AS published FROM reviews")
def moderate_reviews(spark, d):
    r = m.reviews(spark, d).withColumn("published_at", F.when(F.col("status") == "approved", F.col("created")))
    decided = r.filter("review_id % 5 = 0").select("review_id", F.lit("approved").alias("status"))
    return writes.moderate(r, decided, F.lit("2024-01-01").cast("timestamp")).select("review_id", "status", F.col("published_at").isNotNull().alias("published"))


@query("SELECT product_id, i AS place, note, brand FROM (SELECT product_id, brand, unnest(l) AS note, generate_subscripts(l, 1) - 1 AS i FROM (SELECT product_id, brand, list_sort(list(note)) AS l FROM notes JOIN products USING (product_id) GROUP BY 1, 2))")
def zipped_rows(spark, d):
    n = m.notes(spark, d).groupBy("product_id").agg(F.array_sort(F.collect_list("note")).alias("notes")).join(m.products(spark, d).select("product_id", "brand"), "product_id")
    rows = n.select("product_id", F.posexplode(writes.zip_rows(note=F.col("notes"), brand=F.array("brand"))).alias("place", "r"))
    return rows.select("product_id", F.col("place").cast("long").alias("place"), "r.note", "r.brand")
