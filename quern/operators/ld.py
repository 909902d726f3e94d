"""Sizes, offers and variants of a JSON-LD product, as Column expressions over its VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numbers, text
from .work import bound

# Where a product lists its variants.
VARIANTS = ("isSimilarTo", "hasVariant", "model")


def _get(v: Column, name: str) -> Column:
    """A field as text; null where it is missing, empty or a list or object."""
    return bound(F.try_variant_get(v, f"$['{name}']", "variant"), lambda x: F.nullif(F.when(~_kind(x).isin("OBJECT", "ARRAY"), F.try_variant_get(x, "$", "string")), F.lit("")))


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _objects(v: Column) -> Column:
    """The objects of a value that is one or a list of them; others are passed over."""
    listed = F.when(_kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).when(_kind(v) == "OBJECT", F.array(v))
    return F.coalesce(F.filter(listed, lambda x: _kind(x) == "OBJECT"), F.array().cast("array<variant>"))


def offer(product: Column) -> Column:
    """The product's offer, or the first of several (variant)."""
    offers = F.try_variant_get(product, "$.offers", "variant")
    return F.when(_kind(offers) == "ARRAY", F.try_variant_get(product, "$.offers[0]", "variant")).when(_kind(offers) == "OBJECT", offers)


def minor_units(price: Column, currency: Column) -> Column:
    """Minor units of a price: a whole number over 100 with a currency is in minor units already."""
    whole = price.rlike(r"^[0-9]+$") & (price.try_cast("long") > 100) & currency.isNotNull()
    return F.when(whole, price.try_cast("long")).otherwise(numbers.minor_units(price))


def sizes(product: Column, page_url: Column) -> Column:
    """array<struct<place, value, unit, grams, price, currency, sku, availability, source_url, is_primary>>: of the product and its offer, of every offer in a list, and of the variants.

    An entry with no size, price and sku doesn't count; of entries with one value, unit and sku the first stays, and the first of all is primary. A list's
    offers take size and sku from the product where they have none; all take the first offer's currency.
    """
    # what several entries need is worked out once: the record itself may be text that is parsed here
    return bound(product, lambda p: bound(offer(p), lambda of: bound(F.struct(_get(of, "priceCurrency").alias("currency"), _get(p, "size").alias("size"), _get(p, "sku").alias("sku")), lambda own: _sizes(p, of, own, page_url))))


def _sizes(product: Column, of: Column, given: Column, page_url: Column) -> Column:
    currency = given["currency"]

    def entry(size, price, money, sku, stock, url):
        return F.struct(size.alias("size"), price.alias("price"), money.alias("currency"), sku.alias("sku"), stock.alias("availability"), F.coalesce(url, page_url).alias("url"))

    own = entry(given["size"], _get(of, "price"), currency, given["sku"], _get(of, "availability"), _get(of, "url"))
    offers = F.try_variant_get(product, "$.offers", "variant")
    listed = F.transform(F.when(_kind(offers) == "ARRAY", _objects(offers)).otherwise(F.array().cast("array<variant>")), lambda o: entry(F.coalesce(_get(o, "size"), given["size"]), _get(o, "price"), F.coalesce(_get(o, "priceCurrency"), currency), F.coalesce(_get(o, "sku"), given["sku"]), _get(o, "availability"), _get(o, "url")))

    def variant(v):
        return bound(F.try_variant_get(v, "$.offers", "variant"), lambda o: bound(F.when(_kind(o) == "OBJECT", o), lambda deal: sold(v, deal)))

    def sold(v, deal):
        either = lambda name: F.coalesce(_get(deal, name), _get(v, name))
        return entry(_get(v, "size"), either("price"), F.coalesce(_get(deal, "priceCurrency"), currency), _get(v, "sku"), either("availability"), _get(v, "url"))

    variants = F.transform(F.concat(*[_objects(F.try_variant_get(product, f"$.{name}", "variant")) for name in VARIANTS]), variant)
    every = F.filter(F.concat(F.array(own), listed, variants), lambda e: e["size"].isNotNull() | e["price"].isNotNull() | e["sku"].isNotNull())

    def parsed(e):
        return bound(numbers.size_of(e["size"]), lambda size: shaped(e, size))

    def shaped(e, size):
        return F.struct(size["value"].alias("value"), size["unit"].alias("unit"), size["grams"].alias("grams"), minor_units(e["price"], e["currency"]).alias("price"), e["currency"].alias("currency"), e["sku"].alias("sku"), numbers.availability(e["availability"]).alias("availability"), e["url"].alias("source_url"))

    return first_of_sizes(F.transform(every, parsed))


def first_of_sizes(entries: Column) -> Column:
    """Entries without those whose value, unit and sku an earlier one has, numbered, the first of them primary."""
    key = lambda e: F.concat_ws("-", *[F.coalesce(e[f].cast("string"), F.lit("None")) for f in ("value", "unit", "sku")])
    # the first place of a key among all keys tells whether its entry stays
    keyed = F.transform(entries, lambda e: F.struct(key(e).alias("key"), e.alias("e")))
    kept = bound(keyed, lambda all_of: bound(all_of["key"], lambda keys: F.filter(all_of, lambda x, i: F.array_position(keys, x["key"]) == i + 1)["e"]))
    fields = ("value", "unit", "grams", "price", "currency", "sku", "availability", "source_url")
    return F.transform(kept, lambda e, i: F.struct(i.alias("place"), *[e[f].alias(f) for f in fields], (i == 0).alias("is_primary")))


def sizes_in_text(x: Column, currency: Column) -> Column:
    """Sizes that a text offers after "choose your size" (g, kg, oz, ml; repeats once), else its first weight; shaped like `sizes`."""
    chosen = F.regexp_extract(x, r"(?i)choose your size\s*([\d./\s,gkozml]+)", 1)
    found = F.array_distinct(F.transform(F.regexp_extract_all(chosen, F.lit(r"(?i)(\d+)\s*(?:kg|g|oz|ml)\b"), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, r"\s", ""))))
    weight = F.regexp_extract(x, r"(?i)weight:\s*\d+\s*(?:g|oz)\b", 0)
    either = F.when(F.size(found) > 0, found).when(weight != "", F.array(weight)).otherwise(F.array().cast("array<string>"))

    def entry(t, i):
        size, none = numbers.size_of(t), F.lit(None).cast("string")
        return F.struct(i.alias("place"), size["value"].alias("value"), size["unit"].alias("unit"), size["grams"].alias("grams"), F.lit(None).cast("long").alias("price"), currency.alias("currency"), none.alias("sku"), none.alias("availability"), none.alias("source_url"), (i == 0).alias("is_primary"))

    return F.transform(either, entry)


def variant_offer(product: Column, page_text: Column, variant_sku: Column, variant_size: Column, page_url: Column) -> Column:
    """struct of sku, size, price, currency, availability, burn_time_hours, source_url of a variant's page; without a product what is known of the variant."""
    of = offer(product)
    words = F.coalesce(F.nullif(page_text, F.lit("")), _get(product, "description"), F.lit(""))
    none = F.lit(None).cast("string")
    there = F.struct(F.coalesce(_get(product, "sku"), variant_sku).alias("sku"), F.coalesce(F.nullif(variant_size, F.lit("")), _get(product, "size")).alias("size"), _get(of, "price").alias("price"), _get(of, "priceCurrency").alias("currency"), _get(of, "availability").alias("availability"), text.burn_time_hours(words).cast("int").alias("burn_time_hours"), F.coalesce(_get(of, "url"), page_url).alias("source_url"))
    known = F.struct(variant_sku.alias("sku"), variant_size.alias("size"), none.alias("price"), none.alias("currency"), none.alias("availability"), F.lit(None).cast("int").alias("burn_time_hours"), none.alias("source_url"))
    return F.when(product.isNull(), known).otherwise(there)
