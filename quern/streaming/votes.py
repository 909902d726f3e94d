"""Votes and sessions as streams; their final state equals the batch operators'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_votes(stream: DataFrame) -> DataFrame:
    """Last option of each (user, product); state holds one row a key. Use with complete or update mode."""
    return stream.groupBy("user_id", "product_id").agg(F.max_by("option", F.struct("ts", "vote_id")).alias("option"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user_id, start, end, n of sessions that end after `gap` without an event."""
    events = events.withWatermark("ts", late) if events.isStreaming else events
    found = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats within `late` of event time are dropped, and state older than that is let go."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def strays(results: DataFrame, launched: DataFrame, key: str) -> DataFrame:
    """Results that belong to no launched work: a stream against a table."""
    known = launched.select(key).distinct().withColumn("_launched", F.lit(True))
    return results.join(known, key, "left").filter("_launched is null").drop("_launched")
