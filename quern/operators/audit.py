"""Data quality: findings tables, incremental work, worklists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def findings(rows: DataFrame, key: str, checks: dict[str, tuple[str, object]]) -> DataFrame:
    """key, check, severity of every rule that a row breaks: one pass, one array, one explode."""
    broken = [F.when(F.coalesce(rule, F.lit(True)), F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"))) for name, (severity, rule) in checks.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*broken))).alias("f")).select(key, "f.*")


def summary(found: DataFrame, key: str) -> DataFrame:
    """severity, check, rows and distinct keys."""
    return found.groupBy("severity", "check").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_keys"))


def repetition_loop(x, least: int = 8):
    """A substantive line `least` times or more: lines of 25 characters or more that aren't brackets alone."""
    lines = F.filter(F.transform(F.split(x, "\n"), F.trim), lambda line: (F.char_length(line) >= 25) & ~line.rlike(r"^[{}\[\],]+$"))
    # equal lines follow each other in the sorted array, so one fold finds the longest run
    start = F.struct(F.lit("").alias("line"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s, line):
        run = F.when(line == s["line"], s["run"] + 1).otherwise(1)
        return F.struct(line.alias("line"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.array_sort(lines), start, step, lambda s: s["most"]) >= least


def stale(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose content hash has no current output."""
    return inputs.join(outputs.select(key, "hash"), [key, "hash"], "left_anti")


def worklist(lines: DataFrame, sites: DataFrame) -> DataFrame:
    """Each line's site: by slug (the last site wins), else by compact key (the first wins), and how far it is.

    lines: name, place. sites: folder, brand, products, assembled, place.
    """
    by_slug = sites.select(F.explode(F.array_compact(F.array_distinct(F.array("folder", text.slugify(F.col("brand")))))).alias("slug"), "folder", "products", "assembled", "place")
    by_slug = by_slug.groupBy("slug").agg(F.max_by(F.struct("folder", "products", "assembled"), "place").alias("a"))
    by_key = sites.select(F.explode(F.array_distinct(F.array(text.compact_key(F.col("brand")), text.compact_key(F.col("folder"))))).alias("compact"), "folder", "products", "assembled", "place").filter("compact <> ''")
    by_key = by_key.groupBy("compact").agg(F.min_by(F.struct("folder", "products", "assembled"), "place").alias("b"))
    met = lines.withColumn("slug", text.slugify(F.col("name"))).withColumn("compact", text.compact_key(F.col("name"))).join(by_slug, "slug", "left").join(by_key, "compact", "left")
    site = F.coalesce("a", "b")
    status = F.when(site.isNull(), "not-started").when(site["assembled"], "assembled").when(site["products"] > 0, "captured").otherwise("configured")
    return met.select("name", "place", site["folder"].alias("folder"), status.alias("status"))


def valid(rows: DataFrame, rules: dict[str, object]) -> DataFrame:
    """rows with `errors`, the messages of broken rules (null counts as broken)."""
    return rows.withColumn("errors", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(message)) for message, rule in rules.items()])))


def unite(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
