"""Cross-site line dedup by distinct-site spread, in DataFrame functions alone.

A line (its ASCII whitespace at both ends trimmed; blank lines don't count) that
`min_sites` different sites have is boilerplate and is removed everywhere. Each line hash
gets a HyperLogLog sketch of its sites, merged by aggregation with a partial result
in every task, so a line that a third of all documents hold is one row per task. Lines estimated
within `margin` of the threshold get an exact distinct count; those clearly above
are taken as they are. The set of boilerplate lines is broadcast if it has at most
`broadcast_lines` hashes (8 bytes each), else joined by shuffle, where adaptive
execution splits hot lines.

Lines are compared by 64-bit hash. Null text counts as empty; a null site counts as
no site; null ids and repeated rows are cleaned like others, since what is removed depends on the
line alone. A very long text is a list of lines like others; its removed lines are told by their places, so the work is in proportion to its lines. Columns named like the work columns don't clash, for rows travel as one struct. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

MIN_SITES, MARGIN, LG_K, BROADCAST_LINES = 5, 0.05, 12, 1_000_000


def _trimmed(line):
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _lines(keyed: DataFrame) -> DataFrame:
    """key, site, pos, line (hash) of each line with text."""
    line = _trimmed(F.col("line"))
    every = keyed.select("key", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return every.filter(F.char_length(line) > 0).select("key", "site", "pos", F.xxhash64(line).alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """line: the hashes that at least min_sites sites have; lines has `line` and `site`."""
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    low, high = min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1
    spread = cut(spread.filter(F.col("sites") >= low))
    close = spread.filter(F.col("sites") <= high).select("line")
    exact = lines.filter("site is not null").join(close, "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("line")
    return spread.filter(F.col("sites") > high).select("line").union(exact)


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs' columns as struct `row`, with n_lines, n_removed, clean_text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(id_col, text_col).alias("key"), F.col(site_col).cast("string").alias("site"), text.alias("text"))
    lines = _lines(keyed)
    spread = cut(boilerplate(lines, min_sites))
    if spread.count() <= broadcast_lines:
        spread = F.broadcast(spread)
    found = lines.join(spread, "line").groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    both = keyed.join(found, "key", "left").select("row", F.split("text", "\n").alias("lines"), "gone")
    # the lines between one removed line and the next, from -1 to the number of lines
    n = F.size("lines").cast("long")
    edges = F.concat(F.array(F.lit(-1)), F.coalesce("gone", F.array().cast("array<int>")), F.array(F.size("lines")))
    both = both.select("row", "lines", n.alias("n_lines"), (F.size(edges) - 2).cast("long").alias("n_removed"), edges.alias("edges"))
    between = F.transform("edges", lambda e, i: F.when(i > 0, F.slice("lines", F.get("edges", i - 1) + 2, e - F.get("edges", i - 1) - 1)).otherwise(F.array().cast("array<string>")))
    left = F.when(F.col("n_removed") == 0, F.col("lines")).otherwise(F.flatten(between))
    return both.select("row", "n_lines", "n_removed", F.array_join(left, "\n").alias("clean_text"))


def op4_line_dedup(spark, sf_dir):
    clean = remove_boilerplate(table(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM l),
b AS (SELECT trimmed FROM t WHERE trimmed <> '' GROUP BY trimmed HAVING count(DISTINCT source) >= 5),
j AS (SELECT t.*, b.trimmed IS NOT NULL AS gone FROM t LEFT JOIN b USING (trimmed))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_sha256 FROM j GROUP BY doc_id
"""
