"""Queries of launched batches and of extraction, over a log made of the driver's events and over its pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls
from ..streaming import extraction, launcher
from . import model as m
from .queries import QUERIES, SQL


def log(spark, d):
    """Runs by user: each event is a url, in its place; some report, some close, some fail, some do neither."""
    e = m.table(spark, d, "events")
    p = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = e.select(F.col("user_id").cast("string").alias("run"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.col("event_id").alias("k"), p.alias("p"))
    result = (F.col("p") * 9 + F.col("k") % 23) * 1000 + 500 + 2 * (F.col("p") % 200)
    closed = (F.col("p") * 9 + F.col("k") % 31) * 1000 + 1 + 2 * (F.col("p") % 200)
    none = F.lit(None).cast("long")
    step = lambda kind, at, seq: F.struct(F.lit(kind).alias("kind"), at.alias("ms"), F.lit(seq).alias("i"))
    steps = F.array(step("queue", F.lit(0).cast("long"), 0), step("start", F.when(F.col("p") == 0, 0).otherwise(none), 1_000_000), step("closed", F.when(F.col("k") % 4 == 0, closed).otherwise(none), 2), step("result", F.when(F.col("k") % 5 != 0, result).otherwise(none), 3))
    rows = e.select("run", "url", "k", "p", F.explode(F.filter(steps, lambda s: s["ms"].isNotNull())).alias("s"))
    return rows.select("run", F.timestamp_millis("s.ms").alias("ts"), (F.col("s.i") + F.col("p")).cast("long").alias("seq"), F.col("s.kind").alias("kind"), "url", (F.col("k") % 7 != 0).alias("ok"), F.when(F.col("k") % 7 == 0, "bad page").alias("error"))


def launcher_outcomes(spark, d):
    return launcher.outcomes(log(spark, d))


QUERIES["launcher_outcomes"] = launcher_outcomes
SQL["launcher_outcomes"] = """WITH RECURSIVE e AS (SELECT user_id, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p FROM events),
i AS (SELECT user_id, p // 5 AS n, 'u' || k AS url, k % 7 <> 0 AS ok, CASE WHEN k % 5 <> 0 THEN (p * 9 + k % 23) * 1000 + 500 + 2 * (p % 200) END AS r, CASE WHEN k % 4 = 0 THEN (p * 9 + k % 31) * 1000 + 1 + 2 * (p % 200) END AS c FROM e),
b AS (SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS begun FROM e
  UNION ALL SELECT b.user_id, b.n + 1, max(least(CASE WHEN r > begun THEN r ELSE 1e15::BIGINT END, CASE WHEN c > begun THEN c + 5000 ELSE 1e15::BIGINT END, begun + 90000)) FROM b JOIN i ON i.user_id = b.user_id AND i.n = b.n GROUP BY b.user_id, b.n),
o AS (SELECT i.*, CASE WHEN r > begun THEN r ELSE 1e15::BIGINT END AS tr, CASE WHEN c > begun THEN c + 5000 ELSE 1e15::BIGINT END AS tc, begun + 90000 AS tb, least(tr, tc, tb) AS t FROM i JOIN b USING (user_id, n))
SELECT user_id::VARCHAR AS run, url, CASE WHEN t = tr AND ok THEN 'done' ELSE 'failed' END AS outcome, CASE WHEN t = tr THEN CASE WHEN NOT ok THEN 'bad page' END WHEN t = tc THEN 'closed before reporting' ELSE 'batch timeout' END AS error, t::BIGINT AS at FROM o
UNION ALL SELECT user_id::VARCHAR, url, 'stray', CASE WHEN NOT ok THEN 'bad page' END, r::BIGINT FROM o WHERE r < t OR r > t"""


def page_fields():
    """Name and summary of a page by stages."""
    first = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("html", rf"(?s)<{tag}\b[^>]*>(.*?)<", 1), r"\s+", " ")), F.lit(""))
    return {"name": [("heading", F.when(F.col("page_id") % 3 != 0, first("h1"))), ("title", F.when(F.col("page_id") % 5 != 0, first("title")))], "summary": [("aside", F.when(F.col("page_id") % 2 == 0, first("div"))), ("text", first("p"))]}


def extraction_outcomes(spark, d):
    """Pages, some of them turned into challenges, as products and failures."""
    said = F.when(F.col("page_id") % 7 == 0, "<i>Checking your BROWSER</i>").when(F.col("page_id") % 11 == 0, "<i>Just a moment...</i>").otherwise("")
    pages = m.table(spark, d, "pages").withColumn("html", F.concat("html", said))
    found = extraction.extract(pages, F.when(F.col("page_id") % 13 != 0, urls.product_key(F.col("url"))), page_fields())
    return found.select("key", "url", "error", "record.name", "record.summary", F.array_join(F.transform(F.array_sort(F.map_entries("record.stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("stages"))


QUERIES["extraction_outcomes"] = extraction_outcomes
_FIRST = r"nullif(trim(regexp_replace(regexp_extract(html, '<{0}\b[^>]*>(.*?)<', 1, 's'), '\s+', ' ', 'g')), '')"
SQL["extraction_outcomes"] = rf"""WITH p AS (SELECT *, CASE WHEN page_id % 3 <> 0 THEN {_FIRST.format("h1")} END AS a, CASE WHEN page_id % 5 <> 0 THEN {_FIRST.format("title")} END AS b, CASE WHEN page_id % 2 = 0 THEN {_FIRST.format("div")} END AS c, {_FIRST.format("p")} AS e,
  CASE WHEN page_id % 13 <> 0 THEN regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*[^?#]*)', 1)), '/+$', '') END AS key,
  (page_id % 7 = 0 AND length(html) + length('<i>Checking your BROWSER</i>') < 5000) OR (page_id % 7 <> 0 AND page_id % 11 = 0) AS blocked FROM pages),
t AS (SELECT *, CASE WHEN key IS NULL THEN 'no key' WHEN blocked THEN 'blocked' WHEN coalesce(a, b) IS NULL THEN 'no product name extracted' END AS error FROM p)
SELECT key, url, error, CASE WHEN error IS NULL THEN coalesce(a, b) END AS name, CASE WHEN error IS NULL THEN coalesce(c, e) END AS summary,
  CASE WHEN error IS NULL THEN concat_ws(';', CASE WHEN a IS NOT NULL THEN 'name=heading' WHEN b IS NOT NULL THEN 'name=title' END, CASE WHEN c IS NOT NULL THEN 'summary=aside' WHEN e IS NOT NULL THEN 'summary=text' END) END AS stages FROM t"""
