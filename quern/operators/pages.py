"""Saved pages: links, text, JSON-LD products, element tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dom


def links(pages: DataFrame) -> DataFrame:
    """page_id, href, place of the first of each href of a page."""
    href = F.regexp_extract_all("html", F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(href).alias("place", "href"))
    return rows.groupBy("page_id", "href").agg(F.min("place").alias("place"))


def page_text(html):
    """Text of a page: scripts and styles out, blocks on their own lines, entities restored."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    x = F.regexp_replace(x, r"(?i)</(p|div|li|h[1-6]|tr|section|title)>|<br\s*/?>", "\n")
    x = dom.unescape(F.regexp_replace(x, r"(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t ]+", " "), r"\s*\n\s*", "\n"))


#: Levels below an object that its VARIANT can hold; deeper values are null in it, and objects of their own.
LEVELS = 400
_JSON = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+)', re.S)


def _flat(block: str) -> list[str]:
    """Every object of a JSON text that is nested too deep for a VARIANT or a recursive parser, in the order of their beginnings, each as JSON."""
    stack, done, place, at = [], [], 0, 0
    value, end = None, len(block.rstrip())
    while at < end:
        token = _JSON.match(block, at)
        if not token:
            raise ValueError("not JSON")
        at, token = token.end(), token.group(1)
        if token in "[{":
            stack.append((token, place, [], {}, [None]))
            place += 1
            continue
        if token in ",:":
            if not stack:
                raise ValueError("not JSON")
            if token == ":":
                stack[-1][4][0] = value[0]
            continue
        if token in "]}":
            if not stack or stack[-1][0] + token not in ("[]", "{}"):
                raise ValueError("not JSON")
            kind, begun, items, fields, _ = stack.pop()
            made = items if kind == "[" else {k: v for k, (v, _) in fields.items()}
            height = 1 + max((h for _, h in (items if kind == "[" else fields.values())), default=0)
            made = [v for v, _ in items] if kind == "[" else made
            if kind == "{":
                done.append((begun, json.dumps(made)))
            value = (made, height) if height < LEVELS else (None, 0)
        else:
            value = (json.loads(token), 0)
        if stack:
            kind, _, items, fields, key = stack[-1]
            if kind == "[":
                items.append(value)
            elif key[0] is not None:
                fields[key[0]] = value
                key[0] = None
    if stack:
        raise ValueError("not JSON")
    return [text for _, text in sorted(done)]


def _objects(block: str) -> list[str]:
    """Every object of a JSON text, each before those inside it, as JSON; none of a text that isn't JSON."""
    try:
        rest, found = [(json.loads(block), 1)], []
        while rest:
            value, level = rest.pop()
            if level > LEVELS:
                return _flat(block)
            if isinstance(value, dict):
                found.append(json.dumps(value))
                value = list(value.values())
            if isinstance(value, list):
                rest += [(v, level + 1) for v in reversed(value)]
        return found
    except RecursionError:
        try:
            return _flat(block)
        except ValueError:
            return []
    except ValueError:
        return []


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, place (of the block), depth (0, 1, ... of its objects, outer ones first), node (variant) of every object in JSON-LD blocks, however deep; bad JSON is skipped."""
    block = F.regexp_extract_all("html", F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(block).alias("place", "json"))

    def run(part: pd.Series) -> pd.Series:
        return part.map(_objects)

    nodes = rows.select("page_id", "place", F.posexplode(F.pandas_udf(run, "array<string>")("json")).alias("depth", "json"))
    return nodes.select("page_id", "place", "depth", F.try_parse_json("json").alias("node")).filter("node is not null")


def _is_product(node):
    """Whether a node's type, or one of its types, is product in any case."""
    kinds = F.coalesce(F.try_variant_get(node, "$['@type']", "array<string>"), F.array(F.try_variant_get(node, "$['@type']", "string")))
    return F.exists(kinds, lambda k: F.coalesce(F.lower(k) == "product", F.lit(False)))


def product_images(node):
    """Distinct http addresses of a product's images in order: texts, objects with url or contentUrl, and lists of them, up to 16 within each other."""

    def address(v):
        either = [F.try_variant_get(v, f"$.{f}", "string") for f in ("url", "contentUrl")]
        text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return F.coalesce(text, *[F.when(x != "", x) for x in either])

    image = F.try_variant_get(node, "$.image", "variant")
    listed = F.coalesce(F.try_variant_get(image, "$", "array<variant>"), F.array(image))
    flat = listed
    for _ in range(15):
        flat = F.flatten(F.transform(flat, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    return F.array_distinct(F.filter(F.transform(flat, address), lambda u: u.startswith("http")))


def products(nodes: DataFrame) -> DataFrame:
    """The first node of each page whose type is product, with its name, sku, first offer and images."""
    offer = lambda f: F.coalesce(F.try_variant_get("node", f"$.offers.{f}", "string"), F.try_variant_get("node", f"$.offers[0].{f}", "string"))
    rows = nodes.filter(_is_product(F.col("node"))).select(
        "page_id", F.struct("place", "depth").alias("order"),
        F.struct(F.try_variant_get("node", "$.name", "string").alias("name"), F.try_variant_get("node", "$.sku", "string").alias("sku"), offer("price").alias("price"), offer("priceCurrency").alias("currency"), offer("availability").alias("availability"), product_images(F.col("node")).alias("images")).alias("p"),
    )
    return rows.groupBy("page_id").agg(F.min_by("p", "order").alias("p")).select("page_id", "p.*")


def elements(pages: DataFrame) -> DataFrame:
    """page_id, node, parent, tag, path, attrs, text (of all below) of every element, in page order."""
    url = F.col("url") if "url" in pages.columns else F.lit("")
    nodes = dom.elements(dom.trees(pages.select("page_id", url.alias("url"), "html")))
    return nodes.select("page_id", "node", "parent", "tag", F.concat(F.lit("/"), F.array_join("tags", "/")).alias("path"), "attrs", "text")


def repeated_groups(nodes: DataFrame, least: int = 3) -> DataFrame:
    """page_id, parent, signature, members of siblings that look alike: same tag and class words in any order."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda w: w != "")))
    signed = nodes.select("page_id", "parent", F.concat_ws(".", "tag", F.array_join(words, ".")).alias("signature"))
    return signed.groupBy("page_id", "parent", "signature").agg(F.count("*").alias("members")).filter(F.col("members") >= least)


def locate(nodes: DataFrame, wanted: dict[str, str], tag: str | None = None) -> DataFrame:
    """The best element of each page for a recipe of attributes: two points an attribute that agrees, one for the tag; ties go to the first."""
    score = sum((F.when(F.col("attrs")[k] == v, 2).otherwise(0) for k, v in wanted.items()), F.lit(0))
    score = score + (F.when(F.col("tag") == tag, 1).otherwise(0) if tag else F.lit(0))
    scored = nodes.select("page_id", "node", "text", score.alias("score")).filter(F.col("score") >= 2)
    return scored.groupBy("page_id").agg(F.max("score").alias("score"), F.min_by(F.struct("node", "text"), F.struct(-F.col("score"), "node")).alias("best")).select("page_id", "score", "best.node", "best.text")
