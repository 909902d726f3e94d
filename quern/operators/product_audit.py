"""The named checks of extracted products, as one findings table.

products: place, name, slug, source_url, wax_type, notes (array of names), prices (array, one for each size), images (array), from_model.
entries (the log of model calls): source_url, place, pass, raw_response, n_parsed (fields read from it, null where it wasn't read),
n_parsed_notes, kind, name, fallback. failures: url.

Null and empty arrays are the same. An entry or a failure without a url belongs to no product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit

#: Words of prose that no note's name begins with or holds.
NOT_NOTES = ("that", "your", "across", "evokes", "discovery", "unforgettable", "intriguing", "expressing", "precious", "notes", "home", "candle", "luxury")
#: A reply of this many characters has met the model's limit.
LONG_REPLY = 4096


def junk_note(name: Column) -> Column:
    """Whether a note's name is prose: empty, over 40 characters or five words, ending in a full stop, or with a word of prose."""
    name = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?U)^\s+|\s+$", "")
    prose = (f" {w} " for w in NOT_NOTES)
    padded = F.concat(F.lit(" "), F.lower(name), F.lit(" "))
    has = reduce(Column.__or__, [F.contains(padded, F.lit(w)) for w in prose])
    return (name == "") | (F.char_length(name) > 40) | name.endswith(".") | name.rlike(r"(?U)^\S+(\s+\S+){5,}$") | has


def reply_fault(raw: Column, n_parsed: Column) -> Column:
    """Why a reply from which nothing was read looks cut off: too long, a loop, no end; else null."""
    loop = audit.repetition_loop(raw) | raw.rlike(r"(?s)(.{40,}?)\1{7,}")
    end = F.regexp_replace(raw, r"(?U)\s+$", "")
    fault = F.when(F.char_length(raw) >= LONG_REPLY, "very long").when(loop, "repeats itself").when((end != "") & ~end.endswith("}"), "no closing brace")
    return F.when((F.coalesce(raw, F.lit("")) != "") & (F.coalesce(n_parsed, F.lit(0)) == 0), fault)


def findings(products: DataFrame, entries: DataFrame, failures: DataFrame, wax_types: list[str]) -> DataFrame:
    """place, source_url, name, check, severity, detail: all checks but that for duplicates, one pass over products."""
    # replies are judged where they stand: long texts are neither dealt nor sorted
    extract, raw, n_parsed = F.col("pass") == "extract", F.col("raw_response"), F.col("n_parsed")
    told = entries.filter("source_url != ''").withColumns({"_discarded": F.when(extract, (raw != "") & (n_parsed == 0)), "_fault": F.when(extract, reply_fault(raw, n_parsed))})
    called = told.groupBy(F.col("source_url").alias("_url")).agg(
        F.min_by(F.struct("_discarded", "_fault", "n_parsed_notes"), F.when(extract, F.col("place"))).alias("_reply"),
        F.array_sort(F.collect_set(F.when((F.col("pass") == "color") & F.col("fallback"), F.concat(F.coalesce("kind", F.lit("color")), F.lit(":"), F.coalesce("name", F.lit("?")))))).alias("_colors"),
    )
    failed = failures.filter("url != ''").select(F.col("url").alias("_failed")).distinct()
    rows = products.join(called, F.col("source_url") == F.col("_url"), "left").join(failed, F.col("source_url") == F.col("_failed"), "left")

    def empty(c):
        return F.coalesce(F.size(c), F.lit(0)) < 1

    junk = F.filter("notes", junk_note)
    no_notes_read = F.coalesce(F.col("_reply.n_parsed_notes"), F.lit(0)) == 0
    checks = [
        ("pipeline_failure", "medium", F.when(F.col("_failed").isNotNull(), "its url is in the failure log")),
        ("discarded_llm_response", "high", F.when(F.col("_reply._discarded"), "a reply came and nothing was read from it")),
        ("truncated_llm_output", "high", F.col("_reply._fault")),
        ("junk_notes", "medium", F.when(~empty(junk), F.array_join(junk, "|", ""))),
        ("notes_from_text_fallback", "low", F.when(~empty("notes") & ~F.coalesce("from_model", F.lit(False)) & no_notes_read, "notes are not from the model")),
        ("missing_critical", "high", F.when(F.coalesce("name", F.lit("")) == "", "no name")),
        *[("missing_critical", "medium", F.when(empty(c), f"no {what}")) for c, what in (("prices", "sizes"), ("images", "images"), ("notes", "notes"))],
        ("missing_critical", "medium", F.when(~empty("prices") & ~F.exists("prices", lambda p: p.isNotNull()), "no size has a price")),
        ("enum_violation", "medium", F.when(~F.col("wax_type").isin(*wax_types), F.concat(F.lit("wax type "), "wax_type"))),
        ("fallback_color", "low", F.when(~empty("_colors"), F.array_join("_colors", "|"))),
    ]
    found = F.array(*[F.when(detail.isNotNull(), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail"))) for check, severity, detail in checks])
    return rows.select("place", "source_url", "name", F.explode(F.array_compact(found)).alias("f")).select("place", "source_url", "name", "f.*")


def duplicates(products: DataFrame) -> DataFrame:
    """kind (slug or source_url), value, first_place, n of each that several products share; `members` gives their places."""
    each = products.select("place", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("slug", "source_url")])).alias("k")).select("place", "k.*")
    return each.filter("value != ''").groupBy("kind", "value").agg(F.min("place").alias("first_place"), F.count("*").alias("n")).filter("n > 1")


def members(products: DataFrame) -> DataFrame:
    """kind, value, place: one row for each product of each group of duplicates, so that no group is gathered."""
    same = duplicates(products)
    return reduce(DataFrame.union, [products.select(F.lit(c).alias("kind"), F.col(c).alias("value"), "place").join(same.filter(F.col("kind") == c).select("value"), "value", "left_semi").select("kind", "value", "place") for c in ("slug", "source_url")])
