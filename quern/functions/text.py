"""Text normalisation as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules) -> Column:
    """The label of the first pattern that the text matches, in order; null where none does."""
    found = F.when(text.rlike(rules[0][0]), rules[0][1])
    for pattern, label in rules[1:]:
        found = found.when(text.rlike(pattern), label)
    return found


def slugify(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_or_unknown(x: Column) -> Column:
    return F.coalesce(F.nullif(slugify(x), F.lit("")), F.lit("unknown"))


def compact_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def host_slug(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(host), r"^www\.", ""), "[^a-z0-9]+", "_")


def host_core(host: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")[0]


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def title_shouted(x: Column) -> Column:
    """Words without a lower-case letter keep their first letter and lower the rest."""
    return F.array_join(F.transform(F.split(squeeze(x), " "), lambda w: F.when(w.rlike("[a-z]"), w).otherwise(F.concat(F.left(w, F.lit(1)), F.lower(F.substr(w, F.lit(2)))))), " ")


def is_all_caps(x: Column) -> Column:
    return (x == F.upper(x)) & x.rlike("[A-Z]")


def brand_line(line: Column) -> Column:
    """A brand's name from a line of a raw list; null for counts, separators and blank lines."""
    line = F.trim(line)
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(line, REFINED_BRAND, 1)), F.lit("")), line)
    name = F.trim(F.regexp_replace(name, BRAND_COUNT, ""))
    return F.when(~line.rlike(r"^\d*$") & ~line.rlike(SEPARATOR), F.nullif(name, F.lit("")))


#: Wax labels, first match wins.
WAX = (("coconut[\\s-]+soy", "coconut-soy"), ("coconut[\\s-]+rapeseed", "coconut-rapeseed"), ("soy\\s+blend", "soy blend"), ("wax\\s+blend", "blend"), ("vegetable\\s+wax", "vegetable wax"), ("mineral\\s+wax", "mineral wax"), ("soy\\s+wax", "soy"), ("paraffin\\s+wax", "paraffin"), ("beeswax", "beeswax"), ("coconut\\s+wax", "coconut"), ("rapeseed\\s+wax", "rapeseed"), ("palm\\s+wax", "palm"), ("gel\\s+wax", "gel"), ("stearin", "stearin"), ("bayberry", "bayberry"), ("carnauba", "carnauba"), ("tallow", "tallow"), ("apricot\\s+wax", "apricot"), ("ceresin", "ceresin"))
#: Vessel labels, first match wins.
VESSEL = (("glass\\s+jar", "glass"), ("glass\\s+vessel", "glass"), ("in\\s+a\\s+glass", "glass"), ("ceramic", "ceramic"), ("porcelain", "porcelain"), ("\\btin\\b", "tin"), ("metal\\s+(?:jar|tin|vessel)", "metal"), ("concrete", "concrete"), ("wooden?\\s+(?:jar|vessel|box)", "wood"))
#: Marks of page furniture in a description.
FURNITURE = ("add to cart", "choose your size", "add to wishlist", "go to wishlist", "type your letters", "you may also like", "engraving", "out of stock", "best seller", "limited edition", "take a look at the product on your smartphone", "images are illustrative only", "complimentary delivery", "free samples with purchase")

#: Patterns of burn time, scent family, counted brand lines, their counts and separators.
BURN_TIME = r"(?i)(?:burn(?:ing)?\s*time|burns?\s+for|up\s+to)\s*:?\s*(?:up\s+to\s+)?(\d+)\s*(?:hours?|hrs?)\b"
SCENT_FAMILY = r"(?i)olfactive\s+family:\s*([^\n.]+)"
REFINED_BRAND, BRAND_COUNT, SEPARATOR = r"(?i)^\d+\s+Refine by Brand:\s*(.+)$", r"\s*\(\d+\)\s*$", r"^[/\-=_*#.\s]+$"
#: A price beside a cart.
PRICED = r"£\s*\d|[$€]\s*\d|\bqty\b"


def wax_type(x: Column) -> Column:
    return first_match(F.lower(x), WAX)


def vessel_material(x: Column) -> Column:
    return first_match(F.lower(x), VESSEL)


def burn_time_hours(x: Column) -> Column:
    return F.regexp_extract(x, BURN_TIME, 1).try_cast("int")


def scent_summary(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(x, SCENT_FAMILY, 1)), F.lit(""))


def noisy_description(x: Column) -> Column:
    """Too short, page furniture, mostly short lines, or a price beside a cart."""
    low = F.lower(x)
    marks = sum((low.contains(m).cast("int") for m in FURNITURE), F.lit(0))
    lines = F.filter(F.transform(F.split(x, "\n"), F.trim), lambda line: line != "")
    short = F.size(F.filter(lines, lambda line: F.char_length(line) < 28))
    priced = low.rlike(PRICED) & (low.contains("add to cart") | low.contains("choose your size"))
    return F.coalesce((F.char_length(F.trim(x)) < 40) | (marks >= 2) | ((F.size(lines) >= 12) & (short >= 0.55 * F.size(lines))) | priced, F.lit(True))


def junk_name(x: Column, stopwords=("and", "the", "with", "for", "from", "this", "that", "is", "are")) -> Column:
    name = F.trim(x)
    stop = F.lit(False)
    for w in stopwords:
        stop = stop | F.concat(F.lit(" "), F.lower(name), F.lit(" ")).contains(f" {w} ")
    return (name == "") | (F.char_length(name) > 40) | name.endswith(".") | (F.size(F.split(name, r"\s+")) > 5) | stop


def hex_color(x: Column) -> Column:
    x = F.trim(x)
    return F.when(x.rlike("^#?[0-9a-fA-F]{6}$"), F.lower(F.concat(F.lit("#"), F.ltrim(x, F.lit("#")))))


def fallback_color(name: Column) -> Column:
    digest = F.md5(name.cast("binary"))

    def part(i):
        value = F.floor(F.conv(F.substring(digest, i, 2), 16, 10).cast("int") / 2) + 80
        return F.lpad(F.lower(F.hex(value)), 2, "0")

    return F.concat(F.lit("#"), part(1), part(3), part(5))


def duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms)).when(ms < 60000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.format_string("%dm %ds", F.floor(ms / 60000), F.floor(ms % 60000 / 1000)))
