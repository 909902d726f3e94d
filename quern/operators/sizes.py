"""Sizes of a product from its swatches, its variants' offers and its listed sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields of a size that a listed size may fill.
FILLED = ("price", "currency", "availability", "burn_time_hours", "source_url")


def from_swatches(swatches: DataFrame, offers: DataFrame) -> DataFrame:
    """One row for each size and sku of a product's swatches, with its offer's fields.

    swatches: product_id, place, size, sku, available, is_selected, source_url. offers: product_id, place, size,
    sku, price, currency, availability, burn_time_hours, source_url. A swatch takes the offer of its sku, else of its
    size (case apart); of several offers the last counts. An offer's availability wins, even null. The first swatch and selected ones are primary;
    swatches with neither size nor sku are left out.
    """
    fields = ["sku", *FILLED]
    keyed = offers.select("product_id", F.struct("place", *fields).alias("offer"), F.explode(F.array("sku", "size")).alias("key")).filter("key <> ''")
    last = keyed.groupBy("product_id", F.lower("key").alias("key")).agg(F.max_by("offer", "offer.place").alias("offer"))

    order = F.struct("place", "sku", "size", "available", "is_selected", "source_url")
    one = swatches.groupBy("product_id", F.lower(F.coalesce("size", F.lit(""))).alias("_size"), F.lower(F.coalesce("sku", F.lit(""))).alias("_sku"))
    one = one.agg(F.min(order).alias("s")).filter("_size <> '' or _sku <> ''")
    for key in ("_sku", "_size"):
        one = one.join(last.select("product_id", F.col("key").alias(key), F.col("offer").alias(f"by{key}")), ["product_id", key], "left")
    one = one.withColumn("o", F.coalesce("by_sku", "by_size"))
    stock = F.when(F.col("s.available"), "InStock").when(~F.col("s.available"), "OutOfStock")
    first = F.col("s.place") == F.min("s.place").over(Window.partitionBy("product_id"))
    return one.select(
        "product_id", "s.place", "s.size", F.coalesce("s.sku", "o.sku").alias("sku"), "o.price", "o.currency",
        F.when(F.col("o").isNotNull(), F.col("o.availability")).otherwise(stock).alias("availability"), "o.burn_time_hours",
        F.coalesce("o.source_url", "s.source_url").alias("source_url"), (first | F.coalesce("s.is_selected", F.lit(False))).alias("is_primary"),
    )


def fill(sizes: DataFrame, listed: DataFrame) -> DataFrame:
    """sizes with their nulls filled from listed sizes; listed ones that match none follow behind, if their `grams` are known.

    Both have product_id, place, size, sku and the FILLED fields, sizes also is_primary, listed also grams. They match by sku,
    without one by size (case apart); the first size that matches is filled, and the first listed value counts.
    Listed sizes are grouped before the join, so rows never multiply.
    """
    name = F.lower(F.coalesce(F.nullif("sku", F.lit("")), "size"))
    rest = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c) for c in FILLED]
    met = listed.withColumn("_name", name).filter("_name is not null").groupBy("product_id", "_name")
    met = met.agg(F.min("place").alias("place"), F.min_by("size", "place").alias("size"), F.min_by("sku", "place").alias("sku"), F.max("grams").alias("grams"), *rest)

    nth = F.row_number().over(Window.partitionBy("product_id", "_name").orderBy("place"))
    named = sizes.withColumn("_name", name).withColumn("_n", nth)
    other = met.select("product_id", "_name", F.lit(1).alias("_n"), *[F.col(c).alias(f"_{c}") for c in FILLED])
    filled = named.join(other, ["product_id", "_name", "_n"], "left")
    filled = filled.select(*[F.coalesce(c, f"_{c}").alias(c) if c in FILLED else F.col(c) for c in sizes.columns], F.lit(0).alias("_late"))
    added = met.filter("grams is not null").join(named.select("product_id", "_name"), ["product_id", "_name"], "left_anti").withColumn("is_primary", F.lit(False)).withColumn("_late", F.lit(1))
    every = filled.unionByName(added.select(*filled.columns))
    one = Window.partitionBy("product_id")
    behind = F.row_number().over(one.orderBy("_late", "place")) - 1
    every = every.withColumn("place", behind).withColumn("_any", F.bool_or("is_primary").over(one))
    return every.withColumn("is_primary", F.col("is_primary") | (~F.col("_any") & (F.col("place") == 0))).drop("_late", "_any")
