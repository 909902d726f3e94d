"""Queries of audits, pages and search expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import audit, pages, search
from . import model as m
from .dom import dom_signature_groups, locator_best  # noqa: F401  the page queries are one module's to a caller
from .queries import query


@query("""SELECT "check", severity, count(*) AS n, count(DISTINCT doc_id) AS n_keys FROM (SELECT doc_id, 'short_text' AS "check", 'high' AS severity FROM documents WHERE length(text) < 200
UNION ALL SELECT doc_id, 'no_stop', 'low' FROM documents WHERE NOT text LIKE '%.' UNION ALL SELECT doc_id, 'shouted', 'medium' FROM documents WHERE text = upper(text)) GROUP BY 1, 2""")
def audit_summary(spark, d):
    t = F.col("text")
    checks = {"short_text": ("high", F.char_length(t) < 200), "no_stop": ("low", ~t.endswith(".")), "shouted": ("medium", t == F.upper(t))}
    return audit.summary(audit.findings(m.table(spark, d, "documents"), "doc_id", checks), "doc_id")


@query("""SELECT d.doc_id, coalesce(max(n), 0) >= 3 AS loops FROM documents d LEFT JOIN (SELECT doc_id, l, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents) WHERE length(l) >= 25 AND NOT regexp_matches(l, '^[{}\\[\\],]+$') GROUP BY 1, 2) USING (doc_id) GROUP BY 1""")
def repetition_loops(spark, d):
    return m.table(spark, d, "documents").select("doc_id", audit.repetition_loop(F.col("text"), 3).alias("loops"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def hash_incremental(spark, d):
    docs = m.table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    done = docs.filter("doc_id % 3 <> 0").withColumn("hash", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("hash")))
    return audit.stale(docs, done, "doc_id").select("doc_id")


@query("""SELECT name, CASE WHEN k % 4 = 0 THEN NULL ELSE folder END AS folder, CASE WHEN k % 4 = 0 THEN 'not-started' WHEN k % 4 = 1 THEN 'assembled' WHEN k % 4 = 2 THEN 'captured' ELSE 'configured' END AS status
FROM (SELECT s_name AS name, s_suppkey AS k, 'site-' || s_suppkey AS folder FROM supplier)""")
def worklist_two_tier(spark, d):
    s = m.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("place"))
    k = F.col("place") % 4
    # half of the brands are written otherwise, so that only the compact key finds them
    brand = F.when(F.col("place") % 2 == 0, F.regexp_replace(F.upper("name"), "[^A-Z0-9]", "")).otherwise(F.col("name"))
    sites = s.filter(k != 0).select(F.concat(F.lit("site-"), "place").alias("folder"), brand.alias("brand"), F.when(k == 3, 0).otherwise(1).alias("products"), (k == 1).alias("assembled"), "place")
    return audit.worklist(s, sites).select("name", "folder", "status")


@query("""SELECT page_id, href, min(place)::INT AS place FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1) AS h FROM pages)) GROUP BY 1, 2""")
def page_links(spark, d):
    return pages.links(m.table(spark, d, "pages"))


@query("""SELECT page_id, (CASE WHEN regexp_matches(p, '/en/') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(p, '\\.html$') THEN 2 ELSE 0 END + CASE WHEN len(string_split(trim(p, '/'), '/')) >= 3 THEN 1 ELSE 0 END)::INT AS score FROM (SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 3)) AS p FROM pages)""")
def link_scores(spark, d):
    return m.table(spark, d, "pages").select("page_id", urls.path_score(F.col("url"), ["/en/", r"\.html$"]).cast("int").alias("score"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'),
'</(p|div|li|h[1-6]|tr|section|title)>|<br\s*/?>', chr(10), 'gi'), '<[^>]+>', ' ', 'gs'), '&quot;', chr(34)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), '[ \t\x{A0}]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g')) AS text FROM pages""".replace(chr(92) * 2, chr(92)))
def html_to_text(spark, d):
    return m.table(spark, d, "pages").select("page_id", pages.page_text(F.col("html")).alias("text"))


_LD = """, j AS (SELECT p_partkey AS page_id, CASE p_partkey % 4 WHEN 0 THEN '{"@type": "product", "name": "' || p_name || '", "image": "http://a/1", "offers": {"price": ' || p_size || '}}'
WHEN 1 THEN '{"@graph": [{"@type": "WebPage", "mainEntity": {"@type": ["Thing", "PRODUCT"], "sku": "s' || p_partkey || '", "name": "' || p_name || '", "offers": [{"price": "' || p_size || '.50", "priceCurrency": "EUR"}, {"price": "1"}], "image": ["http://a/' || p_size || '", {"url": "http://b/2"}, ["http://a/' || p_size || '", "x"], {"contentUrl": "http://c"}]}}, {"@type": "Product", "name": "later"}]}'
WHEN 2 THEN '[[{"@type": "Offer"}], {"a": {"b": {"c": [{"@type": "Product", "sku": "' || p_size || '"}]}}}]' ELSE '{"@type": "Products"' END AS doc FROM part)"""


@query(_LD + """, t AS (SELECT page_id, t.id, t.value AS v FROM j, json_tree(CASE WHEN json_valid(doc) THEN doc ELSE 'null' END) t WHERE t.type = 'OBJECT'),
k AS (SELECT *, CASE json_type(v, '$."@type"') WHEN 'ARRAY' THEN json_extract_string(v, '$."@type"[*]') ELSE [json_extract_string(v, '$."@type"')] END AS kinds FROM t),
f AS (SELECT page_id, arg_min(v, id) AS v FROM k WHERE list_contains(list_transform(kinds, lambda x: lower(x)), 'product') GROUP BY 1)
SELECT page_id, json_extract_string(v, '$.name') AS name, json_extract_string(v, '$.sku') AS sku, coalesce(json_extract_string(v, '$.offers.price'), json_extract_string(v, '$.offers[0].price')) AS price,
coalesce(json_extract_string(v, '$.offers.priceCurrency'), json_extract_string(v, '$.offers[0].priceCurrency')) AS currency,
coalesce((SELECT string_agg(u, '|' ORDER BY i) FROM (SELECT u, min(id) AS i FROM (SELECT id, json_extract_string(atom, '$') AS u FROM json_tree(coalesce(f.v -> '$.image', 'null'))) WHERE u LIKE 'http%' GROUP BY 1)), '') AS images FROM f""")
def ld_products(spark, d):
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size").cast("string")
    nested = F.concat(
        F.lit('{"@graph": [{"@type": "WebPage", "mainEntity": {"@type": ["Thing", "PRODUCT"], "sku": "s'), k.cast("string"), F.lit('", "name": "'), name, F.lit('", "offers": [{"price": "'), size,
        F.lit('.50", "priceCurrency": "EUR"}, {"price": "1"}], "image": ["http://a/'), size, F.lit('", {"url": "http://b/2"}, ["http://a/'), size, F.lit('", "x"], {"contentUrl": "http://c"}]}}, {"@type": "Product", "name": "later"}]}'),
    )
    plain = F.concat(F.lit('{"@type": "product", "name": "'), name, F.lit('", "image": "http://a/1", "offers": {"price": '), size, F.lit("}}"))
    deep = F.concat(F.lit('[[{"@type": "Offer"}], {"a": {"b": {"c": [{"@type": "Product", "sku": "'), size, F.lit('"}]}}}]'))
    doc = F.when(k % 4 == 0, plain).when(k % 4 == 1, nested).when(k % 4 == 2, deep).otherwise('{"@type": "Products"')
    html = F.concat(F.lit('<p>a</p><script type="application/ld+json">'), doc, F.lit("</script>"))
    found = pages.products(pages.json_ld(m.table(spark, d, "part").select(k.alias("page_id"), html.alias("html"))))
    return found.select("page_id", "name", "sku", "price", "currency", F.coalesce(F.array_join("images", "|"), F.lit("")).alias("images"))


_INDEX = "i AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents))"


@query(f""", {_INDEX} SELECT DISTINCT a.doc_id FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.token = 'of' AND b.token = 'the'
AND a.doc_id IN (SELECT doc_id FROM i WHERE token LIKE 'tion%') AND a.doc_id NOT IN (SELECT doc_id FROM i WHERE token = 'with')""")
def fts_expression(spark, d):
    index = search.postings(m.table(spark, d, "documents"), "doc_id", ["text"])
    return search.search(index, "doc_id", every=[search.Term("of the"), search.Term("tion", prefix=True)], without=[search.Term("with")])


@query("SELECT user_id, product_id, option IN ('click', 'purchase') AND user_id > 10 AS valid FROM last_votes")
def validation(spark, d):
    from .queries import upsert_latest_vote

    rules = {"option: unknown": F.col("option").isin("click", "purchase"), "user_id: too small": F.col("user_id") > 10}
    return audit.valid(upsert_latest_vote(spark, d), rules).select("user_id", "product_id", (F.size("errors") == 0).alias("valid"))


@query("SELECT p_partkey AS product_id, lower(p_brand) = upper(p_brand) AS caps, CASE WHEN regexp_matches(lower(p_type), 'tin') THEN 'tin' END AS vessel FROM part")
def rule_labels(spark, d):
    return m.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), text.is_all_caps(F.lower("p_brand")).alias("caps"), text.first_match(F.lower("p_type"), (("tin", "tin"),)).alias("vessel"))
