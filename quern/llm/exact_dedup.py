"""Exact dedup with a heavy-hitter split.

Texts are equal when they are the same after lower-casing A-Z; null counts as
empty. Of equal texts the row with the largest id stays (null ids come last; of
rows with one id and one text, one stays). Misra-Gries finds the digests that
hold more than 1/k of the rows; their exact winners, 4k/3 rows at most, are broadcast and settle those rows where they lie. All other digests take
the ordinary shuffle, where no group holds more than that share. An empty table
gives an empty table; a very long text is hashed whole, and only its digest is shuffled by assign; columns besides the two named ones pass through
unread, whatever their names, as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, cut, heavy_keys, table

HEAVY = 1024


def digest(text):
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def winners(digests: DataFrame, k: int) -> DataFrame:
    """Verified (text_sha256, keep_id, group_size) of the frequent digests; 4k/3 rows at most."""
    keys = heavy_keys(digests.select(F.xxhash64("text_sha256").alias("key")), k)
    frequent = digests.filter(F.xxhash64("text_sha256").isin(keys) if keys else F.lit(False))
    counted = frequent.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return counted.orderBy(F.desc("group_size"), "text_sha256").limit(2 * k)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = cut(docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256")))
    heavy = cut(winners(digests, k))
    settled = digests.join(F.broadcast(heavy), "text_sha256")
    rest = digests.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    rest = rest.select("text_sha256", "id", F.max("id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"))
    return settled.select(rest.columns).union(rest.select(rest.columns)).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = HEAVY) -> DataFrame:
    """The rows that stay, with all their columns: one for each text."""
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256"))
    heavy = cut(winners(named.select("id", "text_sha256"), k))
    # of a frequent digest only rows with the winning id go on; the shuffle below then sees few of them
    settled = named.join(F.broadcast(heavy), "text_sha256", "left").filter(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    order = Window.partitionBy("text_sha256").orderBy(F.col("id").desc_nulls_last())
    first = settled.select("row", "id", "text_sha256").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return first.select("row.*")


def op2_exact_dedup(spark, sf_dir):
    return assign(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
