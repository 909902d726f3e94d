"""Names and labels shown to readers: brands from hosts, users, prices, sizes, images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slugify

#: A fenced block in a model's reply.
FENCE = r"```(?:json)?\s*([\s\S]*?)```"


def _capital(w: Column) -> Column:
    """First letter upper, the rest as it is (initcap would lower it)."""
    return F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))


def _title(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda w: w != ""), _capital), " ")


def brand_of_host(host: Column) -> Column:
    """struct of name and slug, from the first label of a host."""
    label = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")[0]
    return F.struct(_title(F.split(label, "[-_]")).alias("name"), slugify(label).alias("slug"))


def brand_of_folder(folder: Column) -> Column:
    return F.struct(_title(F.split(folder, "_")).alias("name"), F.replace(folder, F.lit("_"), F.lit("-")).alias("slug"))


def stockist(url: Column) -> Column:
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    name = F.split(F.regexp_replace(F.lower(host), r"^www\.", ""), r"\.")[0]
    return F.coalesce(F.when(host != "", _capital(name)), F.lit("Stockist"))


def username(*candidates: Column) -> Column:
    """The first candidate that is a valid name once lowered and cleaned (3 to 30 of a-z 0-9 _)."""
    cleaned = [F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "^_+|_+$", "") for c in candidates]
    return F.coalesce(*[F.when(c.rlike(r"^[a-z0-9_]{3,30}\z"), c) for c in cleaned])


def price_label(minor: Column, currency: Column) -> Column:
    """Sign and amount; whole amounts without decimals. Thousands are set apart by commas."""
    code = F.coalesce(currency, F.lit("GBP"))
    sign = F.when(code == "GBP", "£").when(code == "EUR", "€").when(code == "USD", "US$").otherwise(F.concat(code, F.lit(" ")))
    return F.concat(sign, F.when(minor % 100 == 0, F.format_number(minor / 100, 0)).otherwise(F.format_number(minor / 100, 2)))


#: Colours of scent families; the first that a family's name holds counts.
FAMILY_COLORS = {
    "citrus": "#e8c547", "floral": "#d4a0b8", "woody": "#8b7355", "green": "#7a9e6e", "spicy": "#c47a4a", "fruity": "#d97a6a",
    "aquatic": "#6ba3c4", "aromatic": "#8fa87a", "gourmand": "#b8956a", "earthy": "#7d6b5a", "musk": "#a89f94", "amber": "#c9a06c",
}
PLAIN_COLOR = "#d5cbbf"


def family_color(family: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(family).contains(name), color) for name, color in FAMILY_COLORS.items()], F.lit(PLAIN_COLOR))


def entity_color(color: Column, family: Column) -> Column:
    """Its own colour, unless null or empty, else that of its family."""
    return F.when(color != "", color).otherwise(family_color(family))


def plain_number(x: Column) -> Column:
    """Whole numbers without a point."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def size_label(value: Column, unit: Column, grams: Column) -> Column:
    number = F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))
    return F.coalesce(F.when(unit != "", F.concat(number, unit)), F.concat(grams.cast("string"), F.lit("g")))


def image_url(raw: Column) -> Column:
    """An absolute http or https url, its width and height filled in; else null."""
    url = F.regexp_replace(F.trim(raw), r"(?i)\{(width|height)\}", "1024")
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(url.rlike(r"(?i)^https?://[^/?#\s]+"), url)


def image_type_of_url(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains(".webp"), "image/webp").when(low.contains(".png"), "image/png").when(low.contains(".jpg") | low.contains(".jpeg"), "image/jpeg")


def json_in(reply: Column) -> Column:
    """The JSON (variant) of a model's reply: fenced, bare, or from the first brace to the last; null if none parses."""
    bare = F.trim(reply)
    fenced = F.regexp_extract(bare, FENCE, 1)
    body = F.when(bare.rlike("```[\\s\\S]*```"), F.trim(fenced)).otherwise(bare)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)\{.*\}", 0), F.lit(""))))
