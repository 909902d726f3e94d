"""Element trees of saved pages: intervals, whole texts, regions, paths, repeated groups and locators.

A page's html becomes tokens by one pattern, a row each; `_grow` reads them in order and makes nodes of them (void elements,
implied end tags), the only step that needs a stack and so the only one outside the JVM. No page is an array of nodes, so a large one takes no
more room at once than its html and texts. All else is Column expressions, joins and groupings of nodes, where a node's descendants are the numbers from its own to its `last`.

Text below a node is a slice of the page's texts. Comments, scripts and styles have no text. Formatting elements that an implied end tag
closes are not opened again. Null html is an empty page, without nodes; page_id tells pages apart.
"""

from __future__ import annotations

import html.entities
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import type_value
from .work import bound, kept

# Rules of HTML.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
BLOCKS = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul")
#: What a start tag ends, and above which open element it looks for it.
ENDS = {
    **dict.fromkeys(BLOCKS, (("p",), ("button", "td", "th", "caption"))),
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
# Attributes that tell one item from the next, regions, weights and thresholds of locators and groups.
INSTANCE_NAMES = r"(?i)^(id|data-id|data-product-id|data-price-amount|data-product-base-price|data-price|data-option-selected|data-attribute-id|href|src|title|alt)$"
STATE_TOKENS = r"(?i)\b(?:active|current|selected|hover|focus|cloned|slick-|swiper-)\b"
REGIONS = {
    "chrome": {"tags": ("nav", "header", "footer"), "roles": ("navigation", "banner", "contentinfo"), "classes": (), "ids": ()},
    "main": {"tags": ("main",), "roles": ("main",), "classes": ("page-main", "main-content"), "ids": ("contentarea", "content")},
    "recommendation": {"tags": (), "roles": (), "classes": ("tile-pricing-wrapper", "product-tile", "swiper-recommendations"), "ids": (), "within_class": "recommendation"},
    "detail": {"tags": (), "roles": (), "classes": ("product-detail", "prices-add-to-cart-actions", "add-to-cart-sticky-wrapper", "price-and-qty-wrapper"), "ids": ()},
}
REGION_POINTS = {"main": 5, "chrome": -8, "detail": 8, "recommendation": -10}
ENOUGH_EVIDENCE, LEAST_GROUP, LEAST_GROUP_SCORE, MOST_GROUPS = 5, 3, 4, 15
NOT_CONTAINERS = ("script", "style", "noscript", "svg", "path", "iframe")

TOKEN = r"""(?s)<[/!]?[A-Za-z][^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>|[^<]+|<"""
ATTRIBUTE = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?"""
BLANK = r"[ \t\n\x0B\f\r ]+"


def unescape(text: Column) -> Column:
    """Entities of numbers and of the names of HTML 4 restored, in the JVM; what is no entity stays."""
    named = F.create_map(*[F.lit(x) for name, code in html.entities.name2codepoint.items() for x in (name, chr(code))], F.lit("apos"), F.lit("'"))
    name = lambda piece: F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)

    def restored(piece):
        n = name(piece)
        code = F.when(n.rlike("^#[xX]"), F.conv(F.substring(n, 3, 8), 16, 10)).otherwise(F.substring(n, 2, 8)).cast("int")
        points = F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.when(n.startswith("#"), points).when(n != "", F.try_element_at(named, n))
        return F.when(found.isNotNull(), F.concat(found, F.substring(piece, F.length(n) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), restored), ""))).otherwise(text)


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK, " "))


def tokens(page_html: Column) -> Column:
    """Tags and texts of a page in order; comments go, scripts and styles are emptied."""
    x = F.regexp_replace(F.coalesce(page_html, F.lit("")), r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"(?is)(<(script|style)\b[^>]*>).*?</\2\s*>", "$1</$2>")
    return F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))


#: Characters of text that one batch of nodes holds, unless one node alone has more.
TOGETHER = 16_000_000
#: What `_grow` tells of a node, besides the columns of its start tag.
GROWN = "node int, parent int, last int, nth int, ancestors array<int>, tags array<string>, nths array<int>, body int, marks int, above int, text string"


def _lists(flat, ends, kind):
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.array(flat, kind))


def _grow(batches):
    """Of tokens in page order (first of its page, kind s start, e end, t text, name, own marks, text; then columns of the tag): one row for each start tag, once its element is closed.

    Tokens come in batches that needn't end with a page: only the open elements and the texts of the page in hand are held between two.
    `body` is how many of a node and its ancestors come up to the last body, `marks` is what any of them is marked by, `above` the same of its parent.
    """
    stack, names, texts, upto = [], [], [], array("q", [0])  # open elements and their names, the page's texts, characters before each
    counts, total, base = {}, 0, 0  # siblings by name below the open elements, nodes of the page, where its texts begin
    done, held = [], None

    def close(at):
        for one in reversed(stack[at:]):
            one[3], one[5] = total - 1, len(texts)
            done.append(one)
            counts.pop(one[1], None)
        del stack[at:], names[at:]

    def rows(table):
        """The closed elements, in runs of limited text."""
        first = 0
        while first < len(done):
            after, size = first, 0
            while after < len(done) and (after == first or size + upto[done[after][5]] - upto[done[after][4]] <= TOGETHER):
                size += upto[done[after][5]] - upto[done[after][4]]
                after += 1
            run = done[first:after]
            place, node, parent, last, begin, end, nth, body, marks, above, chain, tags, nths = zip(*run, strict=True)
            ends, shorter = array("i", [0]), array("i", [0])
            for c in chain:
                ends.append(ends[-1] + len(c))
                shorter.append(shorter[-1] + len(c) - 1)
            ints = lambda x: pa.array(x, pa.int32())
            lists = [_lists([i for c in chain for i in c[:-1]], shorter, pa.int32()), _lists([t for c in tags for t in c], ends, pa.string()), _lists([n for c in nths for n in c], ends, pa.int32())]
            given = table.take(pa.array(place, pa.int64())).combine_chunks().to_batches()[0]
            told = ["".join(texts[i:j]) for i, j in zip(begin, end, strict=True)]
            columns = [*given.columns, ints(node), ints(parent), ints(last), ints(nth), *lists, ints(body), ints(marks), ints(above), pa.array(told, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*given.schema.names, *(f.split()[0] for f in GROWN.split(", "))])
            first = after
        done.clear()

    for batch in batches:
        table = pa.Table.from_batches([batch.select(range(5, batch.num_columns))])
        kept_rows = len(stack)
        for i, one in enumerate(stack):
            one[0] = i
        if held is not None:
            table = pa.concat_tables([held, table])
        for i, (first, kind, name, own, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True), kept_rows):
            if first:
                close(0)
                counts.clear()
                total, base = 0, len(texts)
            if kind == "t":
                texts.append(text)
                upto.append(upto[-1] + len(text))
            elif kind == "e":
                if name in names:
                    close(len(names) - 1 - names[::-1].index(name))
            elif kind == "s":
                if name in ENDS:
                    ended, above = ENDS[name]
                    floor = next((j + 1 for j in range(len(names) - 1, -1, -1) if names[j] in above), 0)
                    at = next((j for j in range(floor, len(names)) if names[j] in ended), None)
                    if at is not None:
                        close(at)
                up = stack[-1] if stack else (0, -1, 0, 0, 0, 0, 0, 0, 0, 0, [], [], [])
                siblings = counts.setdefault(up[1], {})
                nth = siblings[name] = siblings.get(name, 0) + 1
                body = len(up[10]) + 1 if name == "body" else up[7]
                stack.append([i, total, up[1], 0, len(texts), 0, nth, body, own | up[8], up[8], [*up[10], total], [*up[11], name], [*up[12], nth]])
                names.append(name)
                total += 1
                if name in VOID:
                    close(len(stack) - 1)
        yield from rows(table)
        held = table.take(pa.array([one[0] for one in stack], pa.int64()))
        if base:  # texts of pages before the one in hand
            del texts[:base]
            gone = upto[base]
            upto = array("q", (n - gone for n in upto[base:]))
            for one in stack:
                one[4] -= base
            base = 0
    for i, one in enumerate(stack):
        one[0] = i
    close(0)
    if done:
        yield from rows(held)


def trees(pages: DataFrame) -> DataFrame:
    """One row for each element of each page: page_id, url, attrs, and what GROWN lists; text is whole and not squeezed."""
    token = F.col("token")
    kind = F.when(token.rlike("^</[A-Za-z]"), "e").when(token.rlike("^<[A-Za-z]"), "s").when(token.rlike("^<!"), "x").otherwise("t")
    found = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.posexplode(tokens(F.col("html"))).alias("at", "token")).withColumn("kind", kind)
    is_tag = F.col("kind").isin("s", "e")
    found = found.withColumns({"tag": F.when(is_tag, F.lower(F.regexp_extract("token", r"^</?([^\s/>]+)", 1))), "attrs": F.when(F.col("kind") == "s", attributes(token)), "text": F.when(F.col("kind") == "t", unescape(token))})
    own = sum((F.when(_in_region(F.col("attrs"), F.col("tag"), r), 1 << i).otherwise(0) for i, r in enumerate(REGIONS)), F.lit(0))
    found = found.select((F.col("at") == 0).alias("first"), "kind", "tag", F.when(F.col("kind") == "s", own).alias("own"), "text", "page_id", "url", "attrs")
    return found.mapInArrow(_grow, f"page_id long, url string, attrs map<string,string>, {GROWN}")


def attributes(tag: Column) -> Column:
    """Attributes of a start tag: names in lower case, the first of a name counts, values with entities restored, empty where there is none."""
    inner = F.regexp_replace(tag, r"^<[^\s/>]+|/?>$", "")
    each = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(0))
    entry = F.transform(each, lambda a: F.struct(F.lower(F.regexp_extract(a, r"""^([^\s"'>/=]+)""", 1)).alias("key"), F.regexp_extract(a, r"""(?s)^[^\s"'>/=]+\s*=\s*["']?(.*?)["']?$""", 1).alias("value")))
    once = lambda all_of: bound(all_of["key"], lambda keys: F.filter(all_of, lambda e, i: F.array_position(keys, e["key"]) == i + 1))
    return F.map_from_entries(F.transform(bound(entry, once), lambda e: F.struct(e["key"], unescape(e["value"]))))


def class_tokens(attrs: Column) -> Column:
    return F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), lambda w: w != "")


def _in_region(attrs: Column, tag: Column, name: str) -> Column:
    """Whether an element itself opens a region."""
    r = REGIONS[name]
    own = tag.isin(*r["tags"]) if r["tags"] else F.lit(False)
    own = own | (F.coalesce(attrs["role"], F.lit("")).isin(*r["roles"]) if r["roles"] else F.lit(False))
    own = own | (F.coalesce(attrs["id"], F.lit("")).isin(*r["ids"]) if r["ids"] else F.lit(False))
    own = own | (F.arrays_overlap(class_tokens(attrs), F.array(*[F.lit(c) for c in r["classes"]])) if r["classes"] else F.lit(False))
    return own | (F.contains(F.coalesce(attrs["class"], F.lit("")), F.lit(r["within_class"])) if "within_class" in r else F.lit(False))


def elements(found: DataFrame) -> DataFrame:
    """page_id, url and, for every node of `trees`: node, parent, last, nth, ancestors, tag, attrs, text (whole, squeezed), tags (of its ancestors and itself), path (`tag:nth-of-type(n)` from below body), whether it lies in each region, and whether its parent lies in chrome (in_chrome)."""
    below = lambda x: F.slice(x, F.col("body") + 1, F.size(x))
    path = F.zip_with(below(F.col("tags")), below(F.col("nths")), lambda tag, nth: F.concat(tag, F.lit(":nth-of-type("), nth.cast("string"), F.lit(")")))
    marked = lambda marks, r: F.col(marks).bitwiseAND(1 << list(REGIONS).index(r)) != 0
    plain = ["page_id", "url", "node", "parent", "last", "nth", "ancestors", F.try_element_at("tags", F.lit(-1)).alias("tag"), "attrs"]
    return found.select(*plain, squeezed(F.col("text")).alias("text"), "tags", path.alias("path"), *[marked("marks", r).alias(r) for r in REGIONS], marked("above", "chrome").alias("in_chrome"))


def common_ancestors(nodes: DataFrame, groups: list[str]) -> DataFrame:
    """`groups` and the lowest node that holds all of the group's rows: in page order, what the chains of the first and the last have in common."""
    ends, common = _common(F.concat("ancestors", F.array("node")))
    return nodes.groupBy(*groups).agg(*ends).select(*groups, common.alias("ancestor"))


def _common(chain: Column):
    """Aggregates of a group's nodes, and the lowest node that holds them all, made of these."""
    ends = [F.min_by(chain, "node").alias("begun"), F.max_by(chain, "node").alias("ended")]
    return ends, F.try_element_at(F.array_intersect("begun", "ended"), F.lit(-1))


# repeated groups


def instance_specific(key: Column, value: Column) -> Column:
    value = F.trim(F.coalesce(value, F.lit("")))
    return key.rlike(INSTANCE_NAMES) | (key.startswith("data-") & value.rlike("^[0-9]+$")) | (key.rlike("(?i)^data-.*price") & value.rlike("^[0-9.]+$")) | ((key == "class") & value.rlike("[0-9]{3,}"))


def signature_tokens(attrs: Column) -> Column:
    """Sorted tokens that items of a kind share: classes without long numbers and states, data-*, role and itemprop by name, with a value that has no digits."""
    classes = F.filter(class_tokens(attrs), lambda t: ~t.rlike("[0-9]{3,}") & ~t.rlike(STATE_TOKENS))
    classes = F.transform(F.filter(F.transform(classes, type_value), lambda t: t != ""), lambda t: F.concat(F.lit("c~"), t))
    others = F.filter(F.map_entries(attrs), lambda e: (e["key"].startswith("data-") | e["key"].isin("role", "itemprop")) & ~instance_specific(e["key"], e["value"]))
    bare = lambda e: (e["value"] == "") | (e["value"] == e["key"]) | F.contains(type_value(e["value"]), F.lit("#"))
    others = F.transform(others, lambda e: F.when(bare(e), e["key"]).otherwise(F.concat(e["key"], F.lit("~"), type_value(e["value"]))))
    return F.array_sort(F.array_distinct(F.concat(classes, others)))


def repeated_groups(nodes: DataFrame) -> DataFrame:
    """page_id, signature, members (node numbers), container, score, links, product_like of the items that repeat on a page, best first, 15 at most.

    Siblings of one tag count as items where some signature comes three times or more; the most frequent names the
    group. Off navigation, a sibling joins if it has three fifths of the tokens that most siblings share and looks like a product. Groups of one
    signature are one group of the page, however many blocks hold them. `nodes` has the columns of `elements`.
    """
    # links and pictures below each node: each is counted once for every ancestor
    href = F.trim(F.coalesce(F.col("attrs")["href"], F.lit("")))
    link = F.col("attrs")["href"].isNotNull() & ((F.col("tag") == "a") | (F.col("attrs")["role"] == "link")) & ~href.startswith("javascript:") & ~href.startswith("#") & (href != "")
    image = F.col("tag").isin("img", "picture") | F.contains(F.coalesce(F.col("attrs")["style"], F.lit("")), F.lit("background-image"))
    host = lambda u: F.lower(F.regexp_extract(u, r"^(?i:https?:)?//([^/?#:]+)", 1))
    here = ~href.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//)") | (host(href) == host(F.col("url")))
    # what is read of a node is worked out once and kept; texts, paths and attributes are neither kept nor shuffled
    slim = nodes.select("page_id", "node", "parent", "nth", "ancestors", "tag", F.length("text").alias("size"), link.alias("link"), here.alias("here"), image.alias("image"), signature_tokens(F.col("attrs")).alias("tokens"), F.get("tags", F.size("tags") - 2).isin(*NOT_CONTAINERS).alias("skipped"), "in_chrome", "chrome", "main")
    slim = kept(slim)
    below = slim.filter("link or image").select("page_id", F.explode("ancestors").alias("node"), "link", (F.col("link") & F.col("here")).alias("own"), "image")
    below = below.groupBy("page_id", "node").agg(F.count_if("link").alias("links"), F.count_if("own").alias("own_links"), F.count_if("image").alias("images"))
    # the first six children have six of their tag at most, so no more are gathered, however many an element has
    child = slim.filter("nth <= 6").groupBy("page_id", F.col("parent").alias("node")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("node", "tag"))), 1, 6), lambda c: c["tag"]).alias("children"))
    family = slim.groupBy("page_id", "parent").agg(F.count("*").alias("siblings")).filter((F.col("siblings") >= LEAST_GROUP) & (F.col("parent") >= 0))
    items = slim.filter(~F.col("skipped")).hint("merge").join(family, ["page_id", "parent"])
    items = items.join(below.hint("merge"), ["page_id", "node"], "left").join(child.hint("merge"), ["page_id", "node"], "left").na.fill(0, ["links", "own_links", "images"])
    like = F.when(F.col("images") > 0, 2).otherwise(0) + F.when(F.col("size").between(8, 500), 1).otherwise(0) + F.when(F.col("own_links") > 0, 3).otherwise(0) >= 3
    key = F.when(F.size("tokens") > 0, F.concat("tag", F.lit("["), F.array_join("tokens", "|"), F.lit("]"))).when(F.size("children") > 0, F.concat("tag", F.lit("{"), F.array_join("children", ","), F.lit("}")))
    items = items.select("page_id", "node", "parent", "ancestors", "tag", "tokens", "links", like.alias("like"), key.alias("signature"), "in_chrome")
    items = kept(items.filter(F.col("signature").isNotNull()))

    # siblings of one tag by signature: a row each, so that no window holds all children of an element
    bucket, same = ["page_id", "parent", "tag"], ["page_id", "parent", "tag", "signature"]
    kinds = items.groupBy(*same).agg(F.count("*").alias("same"), F.min("node").alias("first"), F.count_if(F.size("tokens") > 0).alias("plain"))
    kinds = kinds.join(kinds.groupBy(*bucket).agg(F.max(F.struct("same", -F.col("first"), "signature")).alias("dominant"), F.sum("plain").alias("all_plain")), bucket)
    kinds = kinds.select(*same, "same", "dominant", F.col("all_plain").alias("plain"))
    rows = items.hint("merge").join(kinds, same)
    rows = rows.filter(F.when(F.col("in_chrome"), F.col("same") >= LEAST_GROUP).otherwise(F.col("dominant.same") >= LEAST_GROUP))
    exact = rows.filter(F.col("in_chrome") | (F.col("signature") == F.col("dominant.signature")))

    shared = rows.filter(~F.col("in_chrome") & (F.size("tokens") > 0) & (F.col("plain") >= LEAST_GROUP)).select(*bucket, "plain", F.explode("tokens").alias("token"))
    shared = shared.groupBy(*bucket, "token").agg(F.count("*").alias("held"), F.first("plain").alias("plain")).filter(F.col("held") >= F.greatest(F.lit(2), F.ceil(F.col("plain") / 2)))
    core = shared.groupBy(*bucket).agg(F.collect_set("token").alias("core"))
    wide = rows.filter(~F.col("in_chrome") & (F.size("tokens") > 0) & F.col("like") & (F.col("signature") != F.col("dominant.signature"))).join(core, bucket)
    wide = wide.filter(F.size(F.array_intersect("tokens", "core")) >= F.ceil(F.size("core") * 3 / 5))
    member = ["page_id", "node", "ancestors", "links", "like"]
    found = exact.select(*member, "signature").union(wide.select(*member, F.col("dominant.signature").alias("signature")))

    ends, common = _common(F.concat("ancestors", F.array("node")))
    groups = found.groupBy("page_id", "signature").agg(
        F.array_sort(F.collect_set("node")).alias("members"), F.sum("links").alias("links"), F.count_if("like").alias("product_like"), F.count("*").alias("n"), *ends
    ).filter(F.col("n") >= LEAST_GROUP).withColumn("ancestor", common)
    place = slim.select("page_id", F.col("node").alias("ancestor"), F.when(F.col("main"), 6).otherwise(0).alias("gain"), F.when(F.col("chrome"), 10).otherwise(0).alias("loss"))
    scored = groups.join(place.hint("merge"), ["page_id", "ancestor"])
    points = F.when(F.col("links") >= F.col("n"), 8).when(F.col("links") >= F.ceil(F.col("n") * 3 / 5), 5).when(F.col("links") > 0, 2).otherwise(0)
    scored = scored.withColumn("score", F.col("n") + points + F.col("product_like") + F.col("gain") - F.col("loss")).filter(F.col("score") >= LEAST_GROUP_SCORE)
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.col("members")[0], "signature"))
    return scored.select("page_id", "signature", "members", F.col("ancestor").alias("container"), "score", "links", "product_like", rank.alias("rank")).filter(F.col("rank") <= MOST_GROUPS)


# locators


def recipe_attributes(attrs: Column) -> Column:
    """What of an element's attributes a recipe may be held against: four classes without long numbers, data-*, itemprop, role; nothing that tells one item from the next."""
    classes = F.slice(F.filter(class_tokens(attrs), lambda t: ~t.rlike("[0-9]{3,}")), 1, 4)
    kept = F.map_filter(attrs, lambda k, v: (k.startswith("data-") | k.isin("itemprop", "role")) & ~instance_specific(k, v))
    with_class = (F.size(classes) > 0) & ~F.coalesce(attrs["class"], F.lit("")).rlike("[0-9]{3,}")
    return F.when(with_class, F.map_concat(kept, F.create_map(F.lit("class"), F.array_join(classes, " ")))).otherwise(kept)


def tail_overlap(a: Column, b: Column) -> Column:
    """How many last segments two paths share."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(F.reverse(a), 1, n), F.slice(F.reverse(b), 1, n), lambda x, y: x == y)
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.greatest(n.cast("long"), F.lit(0)))


def tolerant_overlap(a: Column, b: Column, skips: int = 2) -> Column:
    """How many segments two paths share from their ends, with up to `skips` segments passed over on either side, each where the next one fits."""
    start = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.lit(0).alias("matched"), F.lit(0).alias("skipped"), F.lit(False).alias("over"))

    def step(s, _):
        i, j, matched, skipped = (s[f] for f in ("i", "j", "matched", "skipped"))
        at = lambda x, k: F.get(x, k - 1)
        to = lambda di, dj, dm, ds, over=False: F.struct((i - di).alias("i"), (j - dj).alias("j"), (matched + dm).alias("matched"), (skipped + ds).alias("skipped"), F.lit(over).alias("over"))
        found = F.when(s["over"] | (i < 1) | (j < 1), to(0, 0, 0, 0, True)).when(at(a, i) == at(b, j), to(1, 1, 1, 0))
        found = found.when((skipped < skips) & (i >= 2) & (at(a, i - 1) == at(b, j)), to(1, 0, 0, 1))
        return found.when((skipped < skips) & (j >= 2) & (at(a, i) == at(b, j - 1)), to(0, 1, 0, 1)).otherwise(to(0, 0, 0, 0, True))

    return F.aggregate(F.sequence(F.lit(1), F.size(a) + F.size(b)), start, step)["matched"]


def _selected(attrs: Column, wanted: Column) -> Column:
    """Whether an element has all that a recipe selects by: id, each class, data-*, itemprop, role and name; false where it selects by nothing."""
    used = F.map_filter(wanted, lambda k, v: k.startswith("data-") | k.isin("id", "class", "itemprop", "role", "name") & (v != ""))
    tokens_of = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    fits = F.forall(F.map_entries(used), lambda e: F.when(e["key"] == "class", F.size(F.array_except(tokens_of(e["value"]), class_tokens(attrs))) == 0).otherwise(F.coalesce(F.try_element_at(attrs, e["key"]) == e["value"], F.lit(False))))
    return (F.size(used) > 0) & fits


def _key_of(wanted: Column) -> Column:
    """One thing an element must have to be selected: what a candidate is looked up by."""
    used = F.array_sort(F.transform(F.map_entries(F.map_filter(wanted, lambda k, v: (k.startswith("data-") | k.isin("id", "itemprop", "role", "name", "class")) & (v != ""))), lambda e: F.when(e["key"] == "class", F.concat(F.lit("."), F.get(F.filter(F.split(e["value"], r"\s+"), lambda w: w != ""), F.lit(0)))).otherwise(F.concat(e["key"], F.lit("="), e["value"]))))
    return F.get(used, F.lit(0))


def _keys_of_element(attrs: Column) -> Column:
    classes = F.transform(class_tokens(attrs), lambda t: F.concat(F.lit("."), t))
    rest = F.transform(F.map_entries(F.map_filter(attrs, lambda k, v: k.startswith("data-") | k.isin("id", "itemprop", "role", "name"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_distinct(F.concat(classes, rest))


def _anchored(nodes: DataFrame, recipes: DataFrame) -> DataFrame:
    """recipe, page_id, node that the anchors of recipes lead to: the anchor itself, or below it the first node that the relative path ends at."""
    index = nodes.select("page_id", "node", "last", "attrs", F.explode(_keys_of_element(F.col("attrs"))).alias("key"))
    asked = recipes.filter(F.size("anchor") > 0).select("recipe", F.col("tag").alias("wanted_tag"), "anchor", F.filter(F.split(F.coalesce("relative", F.lit("")), r"\s*>\s*"), lambda s: s != "").alias("steps"), _key_of(F.col("anchor")).alias("key"))
    anchors = index.join(F.broadcast(asked), "key").filter(_selected(F.col("attrs"), F.col("anchor"))).select("recipe", "wanted_tag", "steps", "page_id", F.col("node").alias("from"), "last").distinct()
    alone = anchors.filter(F.size("steps") == 0).select("recipe", "wanted_tag", "page_id", F.col("from").alias("node"))
    # the last step of a path names the tag of what it leads to
    tail = F.regexp_extract(F.try_element_at("steps", F.lit(-1)), r"^([^:\s]+)", 1)
    inner = anchors.filter(F.size("steps") > 0).withColumn("tag", tail).join(nodes.select("page_id", "node", "tag", "path").hint("merge"), ["page_id", "tag"])
    inside = inner.filter((F.col("node") > F.col("from")) & (F.col("node") <= F.col("last")) & (F.size("path") >= F.size("steps")))
    ends = F.slice("path", F.size("path") - F.size("steps") + 1, F.size("steps"))
    fits = F.forall(F.zip_with(ends, "steps", lambda p, s: (p == s) | (F.regexp_extract(p, r"^([^:]+)", 1) == s)), lambda x: x)
    led = inside.filter(fits).groupBy("recipe", "wanted_tag", "page_id", "from").agg(F.min("node").alias("node"))
    found = alone.union(led.select("recipe", "wanted_tag", "page_id", "node")).join(nodes.select("page_id", "node", "tag").hint("merge"), ["page_id", "node"])
    return found.filter(F.col("wanted_tag").isNull() | (F.col("wanted_tag") == F.col("tag"))).select("recipe", "page_id", "node").distinct()


def locate(nodes: DataFrame, recipes: DataFrame) -> DataFrame:
    """recipe, page_id, node, score, evidence, tolerant, value: the best element of each page for each recipe, where the evidence is enough.

    recipes: recipe (id), tag, attrs, text, path (`a > b`), anchor (attributes), relative (path from the anchor), attribute (to be read; null for
    the text). All recipes meet all pages in two joins: elements by tag, and by one attribute that a recipe selects by. The recipes go to every task; a
    table of nodes never does, however small its files are: a page's nodes repeat those of the others and so take far less room there than in memory.
    An anchor that leads to a single element decides; otherwise the best score wins, first of anchored, selected, then tagged elements. A recipe for media
    that finds nothing so is tried again with up to two wrappers more or less on its path.
    """
    nodes = kept(nodes)
    asked = recipes.select("recipe", F.lower("tag").alias("wanted_tag"), F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("wanted"), F.col("text").alias("sample"), F.filter(F.split(F.coalesce("path", F.lit("")), " > "), lambda s: s != "").alias("steps"), "attribute")
    anchored = _anchored(nodes, recipes.select("recipe", F.lower("tag").alias("tag"), F.coalesce("anchor", F.create_map().cast("map<string,string>")).alias("anchor"), "relative"))
    per_page = Window.partitionBy("recipe", "page_id")
    anchored = anchored.withColumns({"led": F.count("*").over(per_page), "first": F.min("node").over(per_page) == F.col("node")})

    none = [F.lit(None).cast("long").alias("led"), F.lit(None).cast("boolean").alias("first")]
    tagged = nodes.join(F.broadcast(asked.select("recipe", F.col("wanted_tag").alias("tag"))), "tag").select("recipe", "page_id", "node", F.lit(2).alias("source"), *none)
    index = nodes.select("page_id", "node", "attrs", F.explode(_keys_of_element(F.col("attrs"))).alias("key"))
    chosen = index.join(F.broadcast(asked.select("recipe", "wanted", _key_of(F.col("wanted")).alias("key"))), "key").filter(_selected(F.col("attrs"), F.col("wanted"))).select("recipe", "page_id", "node", F.lit(1).alias("source"), *none)
    either = tagged.union(chosen).union(anchored.select("recipe", "page_id", "node", F.lit(0).alias("source"), "led", "first"))
    either = either.groupBy("recipe", "page_id", "node").agg(F.min("source").alias("source"), F.max("led").alias("led"), F.max("first").alias("first"))
    rows = either.join(nodes.drop("url", "parent", "last", "nth", "ancestors", "tags").hint("merge"), ["page_id", "node"]).join(F.broadcast(asked), "recipe")

    rows = rows.withColumn("held", recipe_attributes(F.col("attrs")))
    has, target = F.split(F.coalesce(F.col("held")["class"], F.lit("")), r"\s+"), F.filter(F.split(F.coalesce(F.col("wanted")["class"], F.lit("")), r"\s+"), lambda w: w != "")
    covers = (F.size(target) > 0) & (F.size(F.array_except(target, has)) == 0)
    gate = (F.size(target) == 0) | covers
    rows = rows.withColumns({"covers": covers, "gate": gate, "overlap": tail_overlap(F.col("steps"), F.col("path"))})
    equal = lambda e: F.coalesce(F.try_element_at(F.col("held"), e["key"]) == e["value"], F.lit(False))
    total = lambda f: F.aggregate(F.map_entries("wanted"), F.lit(0), lambda s, e: s + f(e))
    attr_score = total(lambda e: F.when(equal(e), 6).when((e["key"] == "class") & F.col("covers"), 4).otherwise(0))
    attr_evidence = total(lambda e: F.when(equal(e), F.when((e["key"] == "class") | F.col("gate"), 5).otherwise(0)).when((e["key"] == "class") & F.col("covers"), 2).otherwise(0))
    known = (F.coalesce("sample", F.lit("")) != "") & (F.col("text") != "")
    exact, part = known & (F.col("text") == F.col("sample")), known & (F.contains("text", "sample") | F.contains("sample", "text"))
    points = lambda whole, some: F.when(exact, whole).when(part, some).otherwise(0)
    first = F.coalesce("first", F.lit(False))
    base = F.when(F.col("wanted_tag") == F.col("tag"), 2).otherwise(0) + attr_score + points(6, 3) + F.col("overlap") * 2 + F.when(first, 10).otherwise(0)
    base = base + sum((F.when(F.col(r), p).otherwise(0) for r, p in REGION_POINTS.items()), F.lit(0))
    sure = attr_evidence + points(3, 1) + F.when(F.col("overlap") >= 2, F.least("overlap", F.lit(5))).otherwise(0) + F.when(first, 8).otherwise(0)
    rows = rows.withColumns({"score": base, "evidence": sure, "alone": F.coalesce(F.col("led") == 1, F.lit(False))})

    media = F.col("wanted_tag").isin("img", "source", "picture") | F.lower("attribute").isin("src", "currentsrc", "srcset")
    tolerant = F.when(F.coalesce(media, F.lit(False)) & (F.col("overlap") < 2), tolerant_overlap(F.col("steps"), F.col("path"))).otherwise(0)
    rows = rows.withColumn("slack", F.when(tolerant >= 4, tolerant).otherwise(0))
    strict = F.col("alone") | (F.col("evidence") >= ENOUGH_EVIDENCE)
    loose = F.col("evidence") + F.least("slack", F.lit(5))
    rows = rows.withColumns({"pass": F.when(strict, 0).when(F.coalesce(media, F.lit(False)) & (loose >= ENOUGH_EVIDENCE), 1)}).filter("pass is not null")
    # the second pass scores all, and is asked only where the first has nothing
    any_strict = F.min("pass").over(per_page)
    rows = rows.withColumn("tolerant", any_strict == 1).filter(F.col("tolerant") | (F.col("pass") == 0))
    rows = rows.withColumns({"score": F.col("score") + F.when(F.col("tolerant"), F.col("slack") * 2).otherwise(0), "evidence": F.when(F.col("tolerant"), loose).otherwise(F.col("evidence"))})
    best = F.row_number().over(per_page.orderBy(F.desc("alone"), F.desc("score"), "source", "node"))
    attribute = F.when(F.lower("attribute").isin("src", "currentsrc"), "src").otherwise(F.col("attribute"))
    value = F.when(F.col("attribute").isNull(), F.col("text")).otherwise(F.try_element_at("attrs", attribute))
    return rows.withColumn("best", best).filter("best = 1").select("recipe", "page_id", "node", F.col("score").cast("long"), F.col("evidence").cast("long"), "tolerant", value.alias("value"))
