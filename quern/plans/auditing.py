"""Queries of the named product checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import product_audit as a
from ..operators.work import spread
from . import model as m
from .queries import query

#: Parts as extracted products with faults, by remainders of their keys.
_FAULTY = """, p AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, p_brand || '-' || p_size AS slug, 'https://a.com/' || (p_partkey - p_partkey % 10 // 9) AS source_url,
CASE p_partkey % 3 WHEN 0 THEN 'soy' WHEN 1 THEN 'clay' END AS wax_type,
CASE WHEN p_partkey % 12 = 0 THEN [] WHEN p_partkey % 5 = 0 THEN list_concat(string_split(p_name, ' '), ['evokes the sea', 'at home', 'Rose.', '', ' notes ', 'a b c d e f', 'homely rose']) ELSE string_split(p_name, ' ') END AS notes,
CASE p_partkey % 6 WHEN 0 THEN [] WHEN 1 THEN [NULL, NULL]::BIGINT[] ELSE [NULL, p_size]::BIGINT[] END AS prices, CASE WHEN p_partkey % 9 <> 0 THEN ['x.png'] END AS images, p_partkey % 4 = 0 AS from_model FROM part),
e AS (SELECT 'https://a.com/' || p_partkey AS url, CASE p_partkey % 6 WHEN 1 THEN '{"a": 1' WHEN 2 THEN '{' || repeat('forty characters of text, again and again; ', 9) || '}' WHEN 3 THEN '{"a": 1} ' WHEN 4 THEN repeat('{"name": "a long line of this list" }' || chr(10), 8) WHEN 5 THEN repeat('ab', 2100) END AS raw,
CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 END AS n_parsed, CASE WHEN p_partkey % 4 = 1 THEN p_partkey % 2 END AS n_notes, CASE WHEN p_partkey % 11 = 0 THEN 'note:a|note:b' END AS colors, p_partkey % 13 = 0 AS failed FROM part)"""
_JUNK = """list_filter(notes, lambda x: trim(x) = '' OR trim(x) LIKE '%.' OR len(regexp_split_to_array(trim(x), '\\s+')) > 5 OR length(trim(x)) > 40 OR len(list_intersect(regexp_split_to_array(lower(trim(x)), ' '),
['that', 'your', 'across', 'evokes', 'discovery', 'unforgettable', 'intriguing', 'expressing', 'precious', 'notes', 'home', 'candle', 'luxury'])) > 0)"""


def _products(spark, d):
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    prose = F.array(*map(F.lit, ["evokes the sea", "at home", "Rose.", "", " notes ", "a b c d e f", "homely rose"]))
    none = F.lit(None).cast("long")
    return m.table(spark, d, "part").select(
        k.alias("place"), F.when(k % 7 != 0, F.col("p_name")).alias("name"), F.concat_ws("-", "p_brand", "p_size").alias("slug"),
        F.concat(F.lit("https://a.com/"), (k - F.when(k % 10 == 9, 1).otherwise(0)).cast("string")).alias("source_url"),
        F.when(k % 3 == 0, "soy").when(k % 3 == 1, "clay").alias("wax_type"),
        F.when(k % 12 == 0, F.array().cast("array<string>")).when(k % 5 == 0, F.concat(words, prose)).otherwise(words).alias("notes"),
        F.when(k % 6 == 0, F.array().cast("array<bigint>")).when(k % 6 == 1, F.array(none, none)).otherwise(F.array(none, F.col("p_size").cast("long"))).alias("prices"),
        F.when(k % 9 != 0, F.array(F.lit("x.png"))).alias("images"), (k % 4 == 0).alias("from_model"),
    )


def _entries(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 6 == 1, '{"a": 1').when(k % 6 == 2, "{" + "forty characters of text, again and again; " * 9 + "}").when(k % 6 == 3, '{"a": 1} ').when(k % 6 == 4, '{"name": "a long line of this list" }\n' * 8).when(k % 6 == 5, "ab" * 2100)

    def entry(when, at, made_by, **of):
        cols = {"source_url": F.concat(F.lit("https://a.com/"), k.cast("string")), "place": F.lit(at), "pass": F.lit(made_by), "raw_response": F.lit(None).cast("string"), "n_parsed": F.lit(None).cast("int"), "n_parsed_notes": F.lit(None).cast("long"), "kind": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "fallback": F.lit(False), **of}
        return F.when(when, F.struct(*[c.alias(n) for n, c in cols.items()]))

    all_of = F.array_compact(F.array(
        entry(k > 0, 0, "extract", raw_response=raw, n_parsed=F.when(k % 4 == 0, 0).when(k % 4 == 1, 2), n_parsed_notes=F.when(k % 4 == 1, k % 2)),
        entry(k > 0, 1, "extract", raw_response=F.lit("a later call, not judged")),
        *[entry(k % 11 == 0, i, "color", kind=F.lit("note"), name=F.lit(n), fallback=F.lit(n != "c")) for i, n in ((2, "b"), (3, "a"), (4, "a"), (5, "c"))],
    ))
    return spread(m.table(spark, d, "part"), "p_partkey").select(F.explode(all_of).alias("e")).select("e.*")


@query(_FAULTY + f""", r AS (SELECT p.*, e.*, {_JUNK} AS junk, raw <> '' AND coalesce(n_parsed, 0) = 0 AS unread FROM p LEFT JOIN e ON source_url = url)
SELECT place, 'pipeline_failure' AS "check", 'medium' AS severity, 'its url is in the failure log' AS detail FROM r WHERE failed
UNION ALL SELECT place, 'discarded_llm_response', 'high', 'a reply came and nothing was read from it' FROM r WHERE raw <> '' AND n_parsed = 0
UNION ALL SELECT place, 'truncated_llm_output', 'high', CASE WHEN length(raw) >= 4096 THEN 'very long' WHEN raw LIKE '%again and again; forty%' OR raw LIKE '%long line%' THEN 'repeats itself' ELSE 'no closing brace' END FROM r WHERE unread AND raw <> '{{"a": 1}} '
UNION ALL SELECT place, 'junk_notes', 'medium', list_aggregate(junk, 'string_agg', '|') FROM r WHERE len(junk) > 0
UNION ALL SELECT place, 'notes_from_text_fallback', 'low', 'notes are not from the model' FROM r WHERE len(notes) > 0 AND NOT from_model AND coalesce(n_notes, 0) = 0
UNION ALL SELECT place, 'missing_critical', 'high', 'no name' FROM r WHERE name IS NULL
UNION ALL SELECT place, 'missing_critical', 'medium', 'no sizes' FROM r WHERE len(prices) = 0
UNION ALL SELECT place, 'missing_critical', 'medium', 'no images' FROM r WHERE images IS NULL
UNION ALL SELECT place, 'missing_critical', 'medium', 'no notes' FROM r WHERE len(notes) = 0
UNION ALL SELECT place, 'missing_critical', 'medium', 'no size has a price' FROM r WHERE len(prices) > 0 AND len(list_filter(prices, lambda x: x IS NOT NULL)) = 0
UNION ALL SELECT place, 'enum_violation', 'medium', 'wax type ' || wax_type FROM r WHERE wax_type NOT IN ('soy', 'beeswax')
UNION ALL SELECT place, 'fallback_color', 'low', colors FROM r WHERE colors IS NOT NULL""")
def product_findings(spark, d):
    failures = m.table(spark, d, "part").filter("p_partkey % 13 = 0").select(F.concat(F.lit("https://a.com/"), F.col("p_partkey").cast("string")).alias("url"))
    return a.findings(_products(spark, d), _entries(spark, d), failures, ["soy", "beeswax"]).select("place", "check", "severity", "detail")


@query(_FAULTY + """, k AS (SELECT 'slug' AS kind, slug AS value, place FROM p UNION ALL SELECT 'source_url', source_url, place FROM p)
SELECT kind, value, place FROM k QUALIFY count(*) OVER (PARTITION BY kind, value) > 1""")
def duplicate_members(spark, d):
    return a.members(_products(spark, d))
