"""Products of a storefront's API as crawl records: offers, images and text of their JSON, and their merge into page records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dom import unescape

#: Fields of an API product; numbers are read as their text, what has another shape as null.
PRODUCT = (
    "title string, handle string, vendor string, body_html string, product_type string, tags array<string>, images array<struct<src string>>, options array<struct<name string, values array<string>>>, "
    "variants array<struct<id string, title string, sku string, price string, available boolean, option1 string, option2 string, option3 string>>"
)
#: The title of a lone variant, what a variant without a name is called, schemas of stock.
LONE, UNNAMED = "Default Title", "Default"
IN_STOCK, OUT_OF_STOCK = "https://schema.org/InStock", "https://schema.org/OutOfStock"
#: Characters of a record's text, the feature's own limit.
TEXT_CHARS = 50_000


def _given(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def product_of(json: Column) -> Column:
    """The fields of an API product's JSON; null or broken JSON gives nulls."""
    return F.from_json(json, PRODUCT)


def plain_text(html: Column) -> Column:
    """HTML as text: scripts and styles out, a line for each block, no more than one empty line in a row; null as empty."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)<\s*br\s*/?\s*>|</\s*(?:p|div|li|h[1-6]|tr)\s*>", "\n")
    x = F.regexp_replace(unescape(F.regexp_replace(x, r"<[^>]+>", " ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def size_name(variant: Column) -> Column:
    """A variant's title, else the first of its options, those that only stand for a lone variant aside."""
    return F.coalesce(*[F.when(_given(variant[f]) != LONE, variant[f]) for f in ("title", "option1", "option2", "option3")])


def offers(product: Column, source_url: Column, currency: Column) -> Column:
    """array<struct<price, currency, availability, sku, url, size>>, one for each variant in order; empty without variants."""

    def offer(v):
        stock = F.when(v["available"], IN_STOCK).otherwise(OUT_OF_STOCK)
        url = F.concat(source_url, F.lit("?variant="), F.coalesce(v["id"], F.lit("None")))
        return F.struct(v["price"].alias("price"), currency.alias("currency"), stock.alias("availability"), _given(v["sku"]).alias("sku"), url.alias("url"), size_name(v).alias("size"))

    return F.transform(F.coalesce(product["variants"], F.array()), offer)


def images(product: Column) -> Column:
    """The images' urls in order, null and empty ones left out."""
    return F.filter(F.coalesce(F.transform(product["images"], lambda i: i["src"]), F.array()), lambda u: u != "")


def text_of(product: Column, description: Column, currency: Column) -> Column:
    """Title, description, type, options, variants and tags as lines; what is missing has no line."""

    def variant(v):
        price = F.coalesce(F.concat_ws(" ", _given(v["price"]), F.when(_given(v["price"]).isNotNull(), F.coalesce(currency, F.lit("None")))), F.lit(""))
        stock = F.when(v["available"], "in stock").otherwise("out of stock")
        return F.trim(F.concat(F.coalesce(size_name(v), F.lit(UNNAMED)), F.lit(" "), price, F.lit(" ("), stock, F.lit(")")))

    def line(label, values, by):
        return F.when(F.size(values) > 0, F.concat(F.lit(label), F.array_join(values, by)))

    told = F.filter(product["options"], lambda o: (o["name"] != "") & (F.size(o["values"]) > 0))
    told = F.transform(told, lambda o: F.concat(o["name"], F.lit(": "), F.array_join(o["values"], ", ")))
    return F.concat_ws(
        "\n", _given(product["title"]), _given(description), F.concat(F.lit("Type: "), _given(product["product_type"])), line("", told, "\n"),
        line("Variants: ", F.transform(product["variants"], variant), "; "), line("Tags: ", product["tags"], ", "),
    )


def records(products: DataFrame, json: str, origin: Column, currency: Column, chars: int | None = TEXT_CHARS) -> DataFrame:
    """products with source_url, name, description, brand, sku, images, offers, text from their API JSON: what stands for a page that was not fetched.

    One projection, no shuffle. A row without JSON has the url of an empty handle, null fields, empty lists and an empty text.
    """
    kept = [c for c in products.columns if c != json]
    rows = products.select(*kept, product_of(F.col(json)).alias("_p"), origin.alias("_origin"), currency.alias("_currency"))
    p = F.col("_p")
    rows = rows.withColumn("_url", F.concat("_origin", F.lit("/products/"), F.coalesce(p["handle"], F.lit("")))).withColumn("_about", plain_text(p["body_html"]))
    text = text_of(p, F.col("_about"), F.col("_currency"))
    return rows.select(
        *kept, F.col("_url").alias("source_url"), p["title"].alias("name"), F.col("_about").alias("description"), p["vendor"].alias("brand"), _first_sku(p).alias("sku"),
        images(p).alias("images"), offers(p, F.col("_url"), F.col("_currency")).alias("offers"), (text if chars is None else F.left(text, F.lit(chars))).alias("text"),
    )


def _first_sku(product: Column) -> Column:
    return _given(F.try_element_at(product["variants"], F.lit(1))["sku"])


def merged(pages: DataFrame, api: DataFrame, key: str) -> DataFrame:
    """pages (key, source_url, name, sku, images, offers) completed by the API's record of the same key.

    The API's offers replace a page's where it has any, with urls below the page's own; its images do where the page has fewer; its
    first variant's sku replaces; its name fills a missing one. Pages without a record stay as they are; of api, one row a key.
    """
    found = api.select(key, *[F.col(c).alias(f"_{c}") for c in ("name", "sku", "images", "offers")])
    moved = F.transform("_offers", lambda o: o.withField("url", F.concat(F.coalesce("source_url", F.lit("")), F.regexp_extract(o["url"], r"\?variant=[^?]*$", 0))))
    rest = [c for c in pages.columns if c not in ("name", "sku", "images", "offers")]
    return pages.join(found, key, "left").select(
        *rest, F.coalesce(_given(F.col("name")), _given(F.col("_name")), "name").alias("name"), F.coalesce("_sku", "sku").alias("sku"),
        F.when(F.size(F.coalesce("_images", F.array())) > F.size(F.coalesce("images", F.array())), F.col("_images")).otherwise(F.col("images")).alias("images"),
        F.when(F.size(F.coalesce("_offers", F.array())) > 0, moved).otherwise(F.col("offers")).alias("offers"),
    )


def endpoint(origin: Column, seed_url: Column) -> Column:
    """Where a shop lists the products of a seed url's collection; "all" and none list everything."""
    handle = F.regexp_extract(seed_url, r"^(?:[^/?#]*://[^/?#]*)?/?(?:[^?#]*?/)??collections/+([^/?#]+)", 1)
    return F.concat(origin, F.when((handle != "") & (F.lower(handle) != "all"), F.concat(F.lit("/collections/"), handle)).otherwise(""), F.lit("/products.json"))
