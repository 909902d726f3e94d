"""Small labels, coercions and list rules of records as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_price(minor: Column, symbol: str = "£") -> Column:
    """Minor units with two decimals and no separators; null stays null."""
    return F.when(minor.isNotNull(), F.format_string(symbol + "%.2f", minor / 100))


def whole_minor_units(amount: Column, currency: Column, parsed: Column) -> Column:
    """A whole number over 100 that comes with a currency is in minor units already; anything else is as parsed from text."""
    whole = amount.cast("string").try_cast("long")
    return F.when((whole > 100) & currency.isNotNull() & amount.cast("string").rlike(r"^\d+$"), whole).otherwise(parsed)


def round_seconds(x: Column) -> Column:
    return F.bround(x, 3)


def long_enough(best: Column, raw: Column, least: int = 200) -> Column:
    """The better text where it has `least` characters, blanks at its ends aside; else the raw one, unless that is blank; null as empty."""
    best, raw = F.coalesce(best, F.lit("")), F.coalesce(raw, F.lit(""))
    return F.when(F.char_length(F.regexp_replace(best, r"^\s+|\s+$", "")) >= least, best).when(raw.rlike(r"\S"), raw).otherwise(best)


def type_value(x: Column) -> Column:
    """An attribute's value as a type: lower case, digits as one #, blanks squeezed, 48 characters."""
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[0-9]+", "#"), r"\s+", " ")), F.lit(48))


def joined_values(values: Column) -> Column:
    """Several raw values as lines, as they are; empty ones and nulls don't count, and none gives an empty text."""
    return F.coalesce(F.array_join(F.filter(values, lambda x: x != ""), "\n"), F.lit(""))


def issues_line(issues: Column) -> Column:
    """Issues (path, message) as one line, `path: message` by semicolons."""
    return F.array_join(F.transform(issues, lambda i: F.when(i["path"] == "", i["message"]).otherwise(F.concat(i["path"], F.lit(": "), i["message"]))), "; ")


def text_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_text(direct: Column, parents: Column) -> Column:
    """The direct value as it is where it has text, else the first parent that has; null if none has."""
    return F.coalesce(F.when(direct.rlike(r"\S"), direct), F.get(F.filter(parents, lambda x: x.rlike(r"\S")), F.lit(0)))


def listed(x: Column) -> Column:
    """A scalar as a list of one, null as an empty list."""
    return F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))


def zipped_names(names: Column, stages: Column, slugs: Column, slug_of, default: str = "unknown") -> Column:
    """struct(name, slug, stage) at every place of names; a missing slug is made from the name, a missing stage is the default."""
    def one(name, i):
        return F.struct(name.alias("name"), F.coalesce(text_or_null(F.get(slugs, i)), slug_of(name)).alias("slug"), F.coalesce(text_or_null(F.get(stages, i)), F.lit(default)).alias("stage"))

    return F.transform(names, one)


def run_id(ts: Column) -> Column:
    """A sortable run id of a UTC time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")
