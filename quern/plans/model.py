"""Catalogue tables seen in the driver's tables: parts as products, line items as sizes, orders as reviews, events as votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify

#: Order status as review status.
STATUS = {"F": "approved", "P": "pending", "O": "rejected"}
PRODUCTS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), slugify(F.col("p_brand")).alias("brand_slug"), slugify(F.col("p_type")).alias("category_slug"), F.col("p_size").alias("size"))


def ratings(spark, d):
    """Five stars by quantity: whole numbers, so that any order of summing gives one average."""
    rating = F.col("l_quantity").cast("long") % 5 + 1
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product_id")).agg(F.avg(rating).alias("rating_avg"), F.count("*").alias("rating_count"))


def notes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.explode(F.split(F.lower("p_name"), " ")).alias("note")).distinct()


def votes(spark, d):
    return table(spark, d, "events").select("user_id", (F.col("event_id") % PRODUCTS).alias("product_id"), F.col("event_type").alias("option"), "ts", F.col("event_id").alias("vote_id"))


def sizes(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("grams"), cents.alias("price"), F.col("l_returnflag").alias("flag"))


def reviews(spark, d):
    status = F.col("o_orderstatus")
    named = F.when(status == "F", "approved").when(status == "P", "pending").otherwise("rejected")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % PRODUCTS).alias("product_id"), named.alias("status"), F.col("o_orderdate").alias("created"))
