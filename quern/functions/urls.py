"""Url parts by one pattern, so that urls which strict parsers refuse keep their keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def product_key(url: Column) -> Column:
    return F.concat(authority(url), F.regexp_replace(F.lower(path(url)), "/+$", ""))


def url_slug(url: Column) -> Column:
    """Slug of the last path part (60 characters) and eight of the url's SHA-1."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda p: p != ""), F.lit(-1))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(last, F.lit("index"))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.left(slug, F.lit(60)), F.lit("-"), F.left(F.sha1(url.cast("binary")), F.lit(8)))


def url_hash(url: Column, n: int = 12) -> Column:
    return F.left(F.sha2(url.cast("binary"), 256), F.lit(n))


def path_score(url: Column, hints) -> Column:
    low = F.lower(path(url))
    depth = F.size(F.split(F.trim(low, F.lit("/")), "/"))
    return sum((F.when(low.rlike(h), 2).otherwise(0) for h in hints), F.lit(0)) + F.when(depth >= 3, 1).otherwise(0)


def safe_segment(x: Column) -> Column:
    """Whether x is one path segment: not empty, no slash of either kind, neither . nor .."""
    return F.coalesce(x.rlike(r"^[^/\\]+$") & ~x.isin(".", ".."), F.lit(False))


def matches_any(url: Column, patterns) -> Column:
    """Whether the lower-cased path has one of the patterns."""
    return F.lower(path(url)).rlike("|".join(f"(?:{p})" for p in patterns))


def same_host(a: Column, b: Column) -> Column:
    """Whether two urls have one host, www. aside."""
    return F.regexp_replace(authority(a), r"^www\.", "") == F.regexp_replace(authority(b), r"^www\.", "")


def same_authority(a: Column, b: Column) -> Column:
    """Whether two urls have one host and port as they stand, case aside."""
    return authority(a) == authority(b)


def image_key_of(product: Column, key: Column) -> Column:
    """Whether an image key belongs to the product: its id, a slash, six letters or digits and a picture's extension."""
    rest = F.substr(key, F.char_length(product) + 2)
    return key.startswith(F.concat(product, F.lit("/"))) & rest.rlike(r"^[a-zA-Z0-9]{6}\.(png|jpg|jpeg|webp)$")


def resolved(way: Column) -> Column:
    """A path without . and .. segments; .. at the root stays there."""
    parts = F.split(way, "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when(p == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(p == ".", held).otherwise(F.concat(held, F.array(p))))
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    joined = F.array_join(kept, "/")
    return F.when(F.contains(way, F.lit("/.")), F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))).otherwise(way)


def url_key(url: Column) -> Column:
    """A key of a url: scheme and host in lower case without the usual port, no fragment, no slash at the end of the path, parameters sorted by name (equal names stay in order) and decoded, + as a blank. What isn't a url is its own key."""
    whole = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme, host = F.lower(F.regexp_extract(whole, PARTS, 1)), F.lower(F.regexp_extract(whole, PARTS, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    given = F.filter(F.split(F.regexp_extract(whole, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: p != "")
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(given, lambda p, i: F.struct(decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"), i.alias("i"), decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("value")))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")
    key = F.concat(scheme, F.lit("://"), host, F.regexp_replace(resolved(path(whole)), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(whole.rlike(PARTS), key).otherwise(url)


def absolute(url: Column, base: Column) -> Column:
    """A link of a page made absolute, without fragment; null unless it begins with / or http and is of http or https. Paths from the root or the folder lose their dots; whole urls stay as they are."""
    link = F.trim(url)
    bare = F.regexp_replace(link, r"(?s)#.*$", "")
    way, query = F.regexp_extract(bare, r"^([^?]*)", 1), F.regexp_extract(bare, r"(?s)(\?.+)$", 1)
    scheme, origin = F.regexp_extract(base, r"^([^:/?#]+):", 1), F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    whole = F.when(link.startswith("//"), F.concat(scheme, F.lit(":"), bare)).when(link.startswith("/"), F.concat(origin, resolved(way), query))
    whole = whole.when(link.rlike(r"^https?://"), bare).when(link.startswith("http") & ~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(origin, resolved(F.concat(F.when(folder == "", "/").otherwise(folder), way)), query))
    return F.when(whole.rlike(r"^https?://"), F.regexp_replace(whole, r"\?$", ""))


def page_filename(key: Column) -> Column:
    """A file name for a product's key: a slug of up to 80 characters (page, if there is none) and ten of the key's SHA-1."""
    slug = F.left(F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(80))
    return F.concat(F.when(slug == "", "page").otherwise(slug), F.lit("-"), F.left(F.sha1(key.cast("binary")), F.lit(10)), F.lit(".html"))


def short_url(url: Column) -> Column:
    """The last path part, decoded, or the host where there is none; the last 40 characters of what can't be read so."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda p: p != ""), F.lit(-1))
    host = F.regexp_replace(authority(url), r"^.*@|:[0-9]*$", "")
    readable = url.rlike(PARTS) & ~F.coalesce(last, F.lit("")).rlike("%(?![0-9A-Fa-f]{2})")
    return F.when(readable, F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), host)).otherwise(F.right(url, F.lit(40)))
