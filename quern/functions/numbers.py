"""Numbers, prices, sizes and units as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Halves go up, negative ones too."""
    return F.floor(x + 0.5)


def percent(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(round_half_up(part * 100.0 / total)).cast("int")


def _first_number(text: Column) -> Column:
    return F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def number_of(text: Column) -> Column:
    return round_half_up(_first_number(text)).cast("long")


def currency_of(text: Column) -> Column:
    """Minor units where the text has a point or a sign; a plain number stays as it is."""
    n = _first_number(text)
    return F.when(text.contains(".") | text.rlike("[£$€]"), round_half_up(n * 100).cast("double")).otherwise(n)


def boolean_of(text: Column) -> Column:
    return F.lower(text).isin("true", "yes", "1")


def minor_units(text: Column) -> Column:
    """A price text with either separator as minor units, halves to even."""
    t = F.regexp_replace(F.trim(text), r"[^\d.,]", "")
    comma, point = t.contains(","), t.contains(".")
    last_comma, last_point = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    plain = F.replace(t, F.lit(","), F.lit(""))
    both = F.when(last_comma > last_point, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(plain)
    cents = F.when(t.rlike(r"^[^,]*,[^,]{2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(plain)
    return F.bround(F.when(comma & point, both).when(comma, cents).otherwise(t).try_cast("double") * 100).cast("long")


def size_of(text: Column) -> Column:
    """struct of value, unit (g, kg, oz, ml, lb) and grams, the last null for volumes."""
    low = F.lower(F.trim(text))
    strict, loose = r"([\d.]+)\s*(kg|lbs|lb|g|oz|ml)\b", r"([\d.]+)\s*(g|kg|oz|ml|lb|lbs)"
    found = F.coalesce(F.nullif(F.regexp_extract(low, strict, 0), F.lit("")), F.nullif(F.regexp_extract(low, loose, 0), F.lit("")))
    value = F.regexp_extract(found, r"[\d.]+", 0).try_cast("double")
    unit = F.regexp_replace(F.regexp_extract(found, "[a-z]+", 0), "^lbs$", "lb")
    factor = F.when(unit == "g", 1.0).when(unit == "kg", 1000.0).when(unit == "oz", 28.3495).when(unit == "lb", 453.592)
    return F.struct(value.alias("value"), unit.alias("unit"), F.bround(value * factor).cast("int").alias("grams"))


def availability(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.contains("instock") | low.contains("in stock"), "InStock").when(low.contains("outofstock") | low.contains("out of stock"), "OutOfStock").otherwise(F.nullif(x, F.lit("")))
