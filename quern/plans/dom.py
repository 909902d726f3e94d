"""Queries of element trees: the driver's pages, and pages made of parts; the SQL walks the tags with a stack of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dom, pages
from ..operators.work import spread
from . import model as m
from .queries import QUERIES, SQL


def _put(sql):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _listed(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]::VARCHAR[]"


_RULES = ", ".join(f"('{name}', {_listed(ended)}, {_listed(above)})" for name, (ended, above) in dom.ENDS.items())
_PLAIN = "replace(replace(replace(replace({0}, '&quot;', chr(34)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
#: nodes (page_id, node, tag, tok, ancestors, parent, nth, last) and texts (page_id, node, text), from pages.
_TREE = rf"""WITH RECURSIVE raw AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(<script\b[^>]*>).*?</script\s*>', '\1</script>', 'gis'), '(<style\b[^>]*>).*?</style\s*>', '\1</style>', 'gis') AS x FROM pages),
tok AS (SELECT page_id, unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM (SELECT page_id, regexp_extract_all(x, '<[/!]?[A-Za-z][^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*>|[^<]+|<', 0, 's') AS t FROM raw)),
rule AS (SELECT * FROM (VALUES {_RULES}) AS r(name, ended, above)),
named AS (SELECT page_id, i, tok, CASE WHEN regexp_matches(tok, '^</[A-Za-z]') THEN 'e' WHEN regexp_matches(tok, '^<[A-Za-z]') THEN 's' WHEN tok LIKE '<!%' THEN 'x' ELSE 't' END AS kind, lower(regexp_extract(tok, '^</?([^\s/>]+)', 1)) AS name FROM tok),
k AS (SELECT named.*, count(*) FILTER (kind = 's') OVER (PARTITION BY page_id ORDER BY i) - 1 AS node, coalesce(ended, []) AS ended, coalesce(above, []) AS above, list_contains({_listed(dom.VOID)}, name) AS void FROM named LEFT JOIN rule USING (name)),
walk AS (SELECT page_id, 0::BIGINT AS i, 'x' AS kind, '' AS name, -1::BIGINT AS node, '' AS tok, []::STRUCT(tag VARCHAR, node BIGINT)[] AS base, []::STRUCT(tag VARCHAR, node BIGINT)[] AS stack FROM raw
  UNION ALL SELECT page_id, i, kind, name, node, tok, base, CASE WHEN kind = 's' AND NOT void THEN list_append(base, {{'tag': name, 'node': node}}) WHEN kind = 's' THEN base
    WHEN kind = 'e' AND own IS NOT NULL THEN stack[:own - 1] ELSE stack END
  FROM (SELECT *, CASE WHEN kind = 's' AND gone IS NOT NULL THEN stack[:gone - 1] ELSE stack END AS base FROM (
    SELECT *, list_min(list_filter(range(floor + 1, len(stack) + 1), lambda j: list_contains(ended, stack[j].tag))) AS gone FROM (
      SELECT k.*, w.stack, coalesce(list_max(list_filter(range(1, len(w.stack) + 1), lambda j: list_contains(k.above, w.stack[j].tag))), 0) AS floor,
        list_max(list_filter(range(1, len(w.stack) + 1), lambda j: w.stack[j].tag = k.name)) AS own FROM walk AS w JOIN k ON k.page_id = w.page_id AND k.i = w.i + 1)))),
starts AS (SELECT page_id, node, name AS tag, tok, list_transform(base, lambda s: s.node) AS ancestors, coalesce(base[-1].node, -1) AS parent FROM walk WHERE kind = 's'),
ends AS (SELECT page_id, a AS node, max(node) AS last FROM (SELECT page_id, node, unnest(list_append(ancestors, node)) AS a FROM starts) GROUP BY 1, 2),
nodes AS (SELECT s.*, last, row_number() OVER (PARTITION BY page_id, parent, tag ORDER BY node) AS nth FROM starts AS s JOIN ends USING (page_id, node)),
texts AS (SELECT page_id, node, trim(regexp_replace(string_agg({_PLAIN.format("tok")}, '' ORDER BY i), '[ \t\n\x0B\f\r\x{{A0}}]+', ' ', 'g')) AS text FROM (SELECT page_id, i, tok, unnest(stack).node AS node FROM walk WHERE kind = 't') GROUP BY 1, 2)"""


@_put(_TREE + r""", above AS (SELECT page_id, node, unnest(list_append(ancestors, node)) AS a FROM nodes),
held AS (SELECT above.page_id, above.node, coalesce(max(a) FILTER (tag = 'body'), -1) AS body, bool_or(tag IN ('nav', 'header', 'footer')) AS chrome FROM above JOIN nodes AS n ON n.page_id = above.page_id AND n.node = a GROUP BY 1, 2),
ways AS (SELECT above.page_id, above.node, string_agg(tag || ':nth-of-type(' || nth || ')', ' > ' ORDER BY a) AS path FROM above JOIN nodes AS n ON n.page_id = above.page_id AND n.node = a JOIN held ON held.page_id = above.page_id AND held.node = above.node WHERE a > body GROUP BY 1, 2)
SELECT page_id, node::INT AS node, parent::INT AS parent, last::INT AS last, nth::INT AS nth, tag, coalesce(path, '') AS path, chrome, sha256(coalesce(text, '')) AS text_sha256
FROM nodes JOIN held USING (page_id, node) LEFT JOIN ways USING (page_id, node) LEFT JOIN texts USING (page_id, node)""")
def dom_nodes(spark, d):
    nodes = dom.elements(dom.trees(m.table(spark, d, "pages")))
    return nodes.select("page_id", "node", "parent", "last", "nth", "tag", F.array_join("path", " > ").alias("path"), "chrome", F.sha2("text", 256).alias("text_sha256"))


@_put(_TREE + """, a AS (SELECT page_id, tag, unnest(list_append(ancestors, node)) AS a FROM nodes WHERE tag IN ('a', 'p', 'b', 'li')),
n AS (SELECT page_id, tag, count(*) AS n FROM nodes GROUP BY 1, 2)
SELECT page_id, tag, max(a)::INT AS ancestor FROM (SELECT page_id, tag, a, count(*) AS held FROM a GROUP BY 1, 2, 3) JOIN n USING (page_id, tag) WHERE held = n GROUP BY 1, 2""")
def dom_common_ancestors(spark, d):
    nodes = dom.elements(dom.trees(m.table(spark, d, "pages"))).filter(F.col("tag").isin("a", "p", "b", "li"))
    return dom.common_ancestors(nodes, ["page_id", "tag"])


@_put(_TREE + r""", s AS (SELECT page_id, parent, tag, list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_extract(tok, '\bclass="([^"]*)"', 1), '\s+'), lambda w: w <> ''))) AS words FROM nodes)
SELECT page_id, parent::INT AS parent, array_to_string(list_prepend(tag, words), '.') || CASE WHEN len(words) = 0 THEN '.' ELSE '' END AS signature, count(*) AS members FROM s GROUP BY ALL HAVING count(*) >= 3""")
def dom_signature_groups(spark, d):
    return pages.repeated_groups(pages.elements(m.table(spark, d, "pages")))


@_put(_TREE + r""", s AS (SELECT page_id, node, CASE WHEN regexp_extract(tok, '\blang="([^"]*)"', 1) = 'en' THEN 2 ELSE 0 END + CASE WHEN regexp_extract(tok, '\bhref="([^"]*)"', 1) = '/Of' THEN 2 ELSE 0 END + CASE WHEN tag = 'html' THEN 1 ELSE 0 END AS score FROM nodes)
SELECT page_id, score::INT AS score, node::INT AS node, coalesce(text, '') AS text FROM s LEFT JOIN texts USING (page_id, node) WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, node) = 1""")
def locator_best(spark, d):
    return pages.locate(pages.elements(m.table(spark, d, "pages")), {"lang": "en", "href": "/Of"}, "html")


def grid_pages(spark, d):
    """A page for each size, whose parts are tiles in three blocks; every 7th is sold out, every 11th a note instead of a tile, and a carousel of other tiles follows."""
    k, name = F.col("p_partkey"), F.col("p_name")
    text = lambda x: F.lit(x)
    tile = F.concat(text('<li class="tile c'), F.when(k % 7 == 0, " sold").otherwise(""), text('" data-key="k'), k.cast("string"), text('"><a href="/p/'), k.cast("string"), text('"><img src=x.jpg></a><span>'), name, text("</span></li>"))
    note = text('<li class="promo">Nothing here')
    cell = F.when(k % 11 == 0, note).otherwise(tile)
    blocks = m.table(spark, d, "part").groupBy(F.col("p_size").alias("page_id"), (k % 3).alias("block")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), cell.alias("cell")))).alias("cells"))
    block = F.concat(text("<section><ul>"), F.array_join(F.transform("cells", lambda c: c["cell"]), ""), text("</ul></section>"))
    carousel = "".join(f'<div class="slide"><div class="tile c car" data-key="x{i}"><a href="/c/{i}"><img src=y></a></div></div>' for i in range(4))
    whole = blocks.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block", block.alias("html")))).alias("blocks"))
    body = F.concat(text("<html><body><main>"), F.array_join(F.transform("blocks", lambda b: b["html"]), ""), text(f"<aside>{carousel}</aside></main></body></html>"))
    return spread(whole, "page_id").select(F.col("page_id").cast("long"), F.lit("https://shop.example.com/list").alias("url"), body.alias("html"))


@_put("""WITH i AS (SELECT p_size AS page_id, p_partkey % 3 AS block, p_partkey AS k, p_partkey % 11 <> 0 AS is_tile, p_partkey % 7 = 0 AS sold FROM part),
c AS (SELECT page_id, block, count(*) AS n, count(*) FILTER (is_tile AND NOT sold) AS plain, count(*) FILTER (is_tile AND sold) AS gone, count(*) FILTER (NOT is_tile) AS notes,
  min(k) FILTER (is_tile AND NOT sold) AS first_plain, min(k) FILTER (is_tile AND sold) AS first_gone, min(k) FILTER (NOT is_tile) AS first_note FROM i GROUP BY 1, 2),
s AS (SELECT *, list_max([{'n': plain, 'f': -coalesce(first_plain, 0), 's': 'plain'}, {'n': gone, 'f': -coalesce(first_gone, 0), 's': 'sold'}, {'n': notes, 'f': -coalesce(first_note, 0), 's': 'note'}]) AS top FROM c),
g AS (SELECT page_id, top.s AS kind, CASE top.s WHEN 'plain' THEN plain + gone WHEN 'sold' THEN gone + CASE WHEN 2 * (plain + gone) >= n THEN plain ELSE 0 END ELSE notes END AS held FROM s WHERE n >= 3 AND top.n >= 3),
t AS (SELECT page_id, kind, sum(held)::BIGINT AS n FROM g GROUP BY 1, 2)
SELECT page_id::BIGINT AS page_id, CASE kind WHEN 'plain' THEN 'li[c~c|c~tile|data-key]' WHEN 'sold' THEN 'li[c~c|c~sold|c~tile|data-key]' ELSE 'li[c~promo]' END AS signature, n AS members,
  CASE kind WHEN 'note' THEN n + 6 ELSE 2 * n + 8 + 6 END AS score FROM t WHERE n >= 3
UNION ALL SELECT page_id, 'section{ul}', 3::BIGINT, (3 + CASE WHEN sum(plain + gone) >= 3 THEN 8 WHEN sum(plain + gone) = 2 THEN 5 WHEN sum(plain + gone) = 1 THEN 2 ELSE 0 END + count(*) FILTER (plain + gone > 0) + 6)::BIGINT FROM c GROUP BY 1 HAVING count(*) = 3
UNION ALL SELECT DISTINCT p_size::BIGINT, 'div[c~slide]', 4::BIGINT, (4 + 8 + 4 + 6)::BIGINT FROM part""")
def product_grids(spark, d):
    found = dom.repeated_groups(dom.elements(dom.trees(grid_pages(spark, d))))
    return found.select("page_id", "signature", F.size("members").cast("long").alias("members"), F.col("score").cast("long").alias("score"))


RECIPES = "recipe string, tag string, attrs map<string,string>, text string, path string, anchor map<string,string>, relative string, attribute string"


def product_pages(spark, d):
    """A page for each part: three of four have the price in its place, some wrap the picture, some lack a class of the title."""
    k = F.col("p_partkey")
    key, text, wraps = k.cast("string"), lambda x: F.lit(x), F.when(k % 3 == 1, 2).when(k % 3 == 2, 1).otherwise(0)
    body = F.concat(
        text('<html><body><header><nav><a href="/">Home<span class="price">0.00</span></a></nav></header><main><div class="product-detail"><div class="info"><h1 class="title'), F.when(k % 5 == 0, "").otherwise(" big"),
        text('" id="p'), key, text('">'), F.col("p_name"), text("</h1>"), F.when(k % 4 == 2, "").otherwise(F.concat(text('<span class="price">'), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), text("</span>"))),
        text('</div><div class="gallery"><figure>'), F.repeat(F.lit('<div class="zoom">'), wraps), text("<picture><img src=/i/"), key, text(".jpg alt=x></picture>"), F.repeat(F.lit("</div>"), wraps),
        text('</figure></div><form data-kind="buy"><p>Now <a href="/buy/'), key, text('">buy</a></p></form></div><ul class="product-tile"><li><span class="price">1.00</span><picture><img src=/other.jpg></picture></li></ul></main></body></html>'),
    )
    return spread(m.table(spark, d, "part"), "p_partkey").select(k.cast("long").alias("page_id"), F.lit("https://shop.example.com/p").alias("url"), body.alias("html"))


def recipes(spark):
    way = "main:nth-of-type(1) > div:nth-of-type(1) > div:nth-of-type(2) > figure:nth-of-type(1) > picture:nth-of-type(1) > img:nth-of-type(1)"
    rows = [
        ("title", "h1", {"class": "title big"}, None, "main:nth-of-type(1) > div:nth-of-type(1) > div:nth-of-type(1) > h1:nth-of-type(1)", {}, None, None),
        ("price", "span", {"class": "price"}, None, None, None, None, None),
        ("hero", "img", {}, None, way.replace("img:", "a:nth-of-type(1) > img:"), {}, None, "currentSrc"),
        ("buy", "a", {}, None, None, {"data-kind": "buy"}, "a", "href"),
        ("none", "video", {"class": "player"}, None, None, {}, None, "src"),
    ]
    return spark.createDataFrame(rows, RECIPES)


@_put("""SELECT 'title' AS recipe, p_partkey::BIGINT AS page_id, false AS tolerant, p_name AS value FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT 'price', p_partkey, false, CASE WHEN p_partkey % 4 = 2 THEN '1.00' ELSE p_retailprice::DECIMAL(12,2)::VARCHAR END FROM part
UNION ALL SELECT 'hero', p_partkey, true, '/i/' || p_partkey || '.jpg' FROM part WHERE p_partkey % 3 <> 1
UNION ALL SELECT 'buy', p_partkey, false, '/buy/' || p_partkey FROM part""")
def page_locators(spark, d):
    return dom.locate(dom.elements(dom.trees(product_pages(spark, d))), recipes(spark)).select("recipe", "page_id", "tolerant", "value")
