"""Queries of product views, search documents, child rows and url keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import catalogue as c
from ..operators import views as v
from ..operators.pages import links
from . import model as m
from .queries import query

_NOTES = """, n AS (SELECT p_partkey AS product_id, unnest(string_split(lower(p_name), ' ')) AS note, generate_subscripts(string_split(lower(p_name), ' '), 1) - 1 AS position,
CASE p_partkey % 5 WHEN 0 THEN 'top' WHEN 1 THEN 'Heart' WHEN 2 THEN 'base' WHEN 4 THEN 'odd' END AS stage FROM part)"""
_TEXTS = """, bodies AS (SELECT product_id, status, 'Order ' || review_id || ', ' || status || repeat(' very good', 30) AS body FROM reviews),
nn AS (SELECT product_id, string_agg(DISTINCT note, ' ' ORDER BY note) AS notes FROM notes GROUP BY 1),
rr AS (SELECT product_id, string_agg(DISTINCT replace(left(body, 200), ',', ' '), ' ' ORDER BY replace(left(body, 200), ',', ' ')) AS reviews FROM bodies WHERE status = 'approved' GROUP BY 1)"""


def _notes(spark, d):
    k = F.col("p_partkey")
    stage = F.when(k % 5 == 0, "top").when(k % 5 == 1, "Heart").when(k % 5 == 2, "base").when(k % 5 == 4, "odd")
    return m.table(spark, d, "part").select(k.alias("product_id"), stage.alias("stage"), F.posexplode(F.split(F.lower("p_name"), " ")).alias("position", "note"))


def _accords(spark, d):
    return m.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.lower("p_type").alias("accord"))


def _bodies(spark, d):
    body = F.concat(F.lit("Order "), F.col("review_id").cast("string"), F.lit(", "), "status", F.repeat(F.lit(" very good"), F.lit(30)))
    return m.reviews(spark, d).select("product_id", "status", body.alias("body"), (F.col("review_id") % 5 + 1).alias("stars"))


@query(_NOTES + """ SELECT product_id, CASE s WHEN 'top' THEN 1 WHEN 'middle' THEN 2 WHEN 'base' THEN 3 WHEN 'general' THEN 4 ELSE 5 END AS place, s AS stage, string_agg(note, '|' ORDER BY position, note) AS notes
FROM (SELECT *, CASE lower(coalesce(stage, 'general')) WHEN 'top' THEN 'top' WHEN 'heart' THEN 'middle' WHEN 'base' THEN 'base' WHEN 'general' THEN 'general' ELSE 'Notes' END AS s FROM n) GROUP BY 1, 2, 3""")
def notes_by_stage(spark, d):
    return v.notes_by_stage(_notes(spark, d)).withColumn("notes", F.array_join("notes", "|"))


@query("SELECT product_id, string_agg(order_id || ':' || line, '|' ORDER BY line, CASE flag WHEN 'A' THEN 0 ELSE 1 END, grams, order_id) AS sizes FROM sizes GROUP BY 1")
def ordered_sizes(spark, d):
    order = [F.col("line"), F.when(F.col("flag") == "A", 0).otherwise(1), F.col("grams"), F.col("order_id")]
    found = v.ordered_children(m.sizes(spark, d), "product_id", order, ["order_id", "line"], "sizes")
    return found.select("product_id", F.array_join(F.transform("sizes", lambda s: F.concat_ws(":", s["order_id"], s["line"])), "|").alias("sizes"))


@query("SELECT product_id, string_agg(review_id::VARCHAR, '|' ORDER BY created DESC, review_id) AS reviews FROM reviews WHERE status = 'approved' GROUP BY 1")
def ordered_reviews(spark, d):
    rows = m.reviews(spark, d).filter("status = 'approved'")
    found = v.ordered_children(rows, "product_id", [-F.unix_micros(F.col("created").cast("timestamp")), F.col("review_id")], ["review_id"], "reviews")
    return found.select("product_id", F.array_join(F.transform("reviews", lambda r: r["review_id"].cast("string")), "|").alias("reviews"))


@query(""", a AS (SELECT p_partkey AS product_id, p_partkey AS k, unnest(['a', 'b', 'c', 'd']) AS name, unnest([p_partkey * 7 % 50, NULL, p_partkey * 11 % 50, p_partkey * 3 % 50]) AS pct, unnest([0, 1, 2, 3]) AS i FROM part)
SELECT product_id, string_agg(name, '|' ORDER BY coalesce(pct, -1) DESC, i) AS accords FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(pct, -1) DESC, i) AS r FROM a) WHERE r <= 2 GROUP BY 1""")
def top_accords(spark, d):
    k = F.col("p_partkey")
    bars = F.array(*[F.struct(F.lit(name).alias("name"), pct.alias("pct")) for name, pct in (("a", k * 7 % 50), ("b", F.lit(None).cast("long")), ("c", k * 11 % 50), ("d", k * 3 % 50))])
    best = v.top(v.accord_bars(F.col("bars")), 2)
    return m.table(spark, d, "part").select(k.alias("product_id"), bars.alias("bars")).select("product_id", F.array_join(F.transform(best, lambda x: x["name"]), "|").alias("accords"))


@query(""", own AS (SELECT product_id, avg(review_id % 5 + 1) AS a, count(*) AS n FROM reviews WHERE status = 'approved' GROUP BY 1)
SELECT product_id, coalesce(a, rating_avg) AS rating, coalesce(n, rating_count, 0) AS rating_count FROM products LEFT JOIN own USING (product_id) LEFT JOIN ratings USING (product_id)""")
def rating_view(spark, d):
    return v.rating_view(m.products(spark, d).select("product_id"), _bodies(spark, d), m.ratings(spark, d))


@query(_TEXTS + """ SELECT product_id, name, brand, coalesce(notes, '') AS notes, lower(p_type) AS accords, coalesce(reviews, '') AS reviews
FROM products JOIN part ON product_id = p_partkey LEFT JOIN nn USING (product_id) LEFT JOIN rr USING (product_id)""")
def search_documents(spark, d):
    return v.search_documents(m.products(spark, d), m.notes(spark, d), _accords(spark, d), _bodies(spark, d))


@query(_TEXTS + """ SELECT product_id, name, CASE WHEN brand_slug = 'brand-12' THEN 'Renamed' ELSE brand END AS brand, coalesce(notes, '') AS notes, lower(p_type) AS accords, coalesce(reviews, '') AS reviews
FROM products JOIN part ON product_id = p_partkey LEFT JOIN nn USING (product_id) LEFT JOIN rr USING (product_id)""")
def search_rebuild(spark, d):
    """A brand is renamed; its products' documents alone are built again."""
    products, rest = m.products(spark, d), (m.notes(spark, d), _accords(spark, d), _bodies(spark, d))
    renamed = products.withColumn("brand", F.when(F.col("brand_slug") == "brand-12", "Renamed").otherwise(F.col("brand")))
    fresh = v.search_documents(renamed, *rest, only=products.filter("brand_slug = 'brand-12'"))
    return v.replace_documents(v.search_documents(products, *rest), fresh)


@query("SELECT p_partkey AS product_id, p_name AS name FROM part WHERE lower(p_type) IN ('economy', 'promo')")
def facet_accords(spark, d):
    chosen = c.filters_of({"accords": "economy, ,promo", "sort": "name"})
    return c.facet(m.products(spark, d), chosen, m.ratings(spark, d), m.notes(spark, d), None, _accords(spark, d)).select("product_id", "name")


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(k, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) || '-' || left(sha1(k), 10) || '.html' AS file,
regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_transform(list_sort(list_transform(string_split(q, '&'), lambda p, i: {'n': split_part(p, '=', 1), 'i': i, 'p': p})), lambda x: x.p), '&') END AS key,
coalesce(nullif(regexp_extract(regexp_replace(regexp_replace(url, '^[^:]+://[^/?#]*', ''), '[?#].*$', ''), '([^/]+)/*$', 1), ''), regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS short,
regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') = 'ththble.example.com' AS same, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) = 'www.ththble.example.com' AS one
FROM (SELECT *, regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) AS q, lower(regexp_replace(regexp_replace(regexp_replace(url, '^[^:]+://', ''), '[?#].*$', ''), '/+$', '')) AS k FROM pages WHERE url IS NOT NULL)""")
def page_keys(spark, d):
    u = F.col("url")
    here = F.lit("http://www.ththble.example.com/x")
    pages = m.table(spark, d, "pages").filter("url is not null")
    return pages.select("page_id", urls.page_filename(urls.product_key(u)).alias("file"), urls.url_key(u).alias("key"), urls.short_url(u).alias("short"), urls.same_host(u, here).alias("same"), urls.same_authority(u, here).alias("one"))


#: Each page's links and, by their place, forms of them that tell the rules apart.
_LINKS = r""", l AS (SELECT page_id, href, min(place) AS place FROM (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS h FROM pages)) GROUP BY 1, 2)"""


@query(_LINKS + r"""SELECT page_id, place::INT AS place, CASE (page_id + place) % 10 WHEN 0 THEN o || href WHEN 4 THEN o || '/a/c' || href WHEN 5 THEN 'http://Other.org/x/../y' || href WHEN 6 THEN p || '//cdn.org' || href
WHEN 7 THEN o || regexp_replace(w, '[^/]*$', '') || 'y?a=../b' WHEN 8 THEN o || '/b/' END AS link
FROM (SELECT l.*, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS o, regexp_extract(url, '^([^/]+)', 1) AS p, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS w FROM l JOIN pages USING (page_id))""")
def absolute_links(spark, d):
    pages = m.table(spark, d, "pages")
    n, href = (F.col("page_id") + F.col("place")) % 10, F.col("href")
    forms = [href, F.concat(F.lit(".."), href), F.lit("?page=2"), F.concat(F.lit("ftp://z"), href), F.concat(F.lit(" /a/./b/../c"), href, F.lit("#f")), F.concat(F.lit("http://Other.org/x/../y"), href, F.lit("#f")), F.concat(F.lit("//cdn.org"), href), F.lit("httpx/../y?a=../b"), F.lit("/../a/../b/c/.."), F.lit("HTTP://q.org")]
    given = links(pages).select("page_id", "place", F.coalesce(*[F.when(n == i, f) for i, f in enumerate(forms)]).alias("given"))
    return given.join(pages.select("page_id", "url"), "page_id").select("page_id", "place", urls.absolute(F.col("given"), F.col("url")).alias("link"))


@query(_LINKS + r"""SELECT page_id, place::INT AS place, CASE (page_id + place) % 6 WHEN 0 THEN 'http://a.org/x' || h || '?a=9&a=1&ab=' || place || '&b=2' WHEN 1 THEN 'https://a.org:80' || h || '?q=a&b=1 2+' WHEN 2 THEN 'http://a.org' || h || '?=v&a=' WHEN 3 THEN 'no url' || href
WHEN 4 THEN 'http://a.org/c' || h ELSE 'https://a.org' END AS key, CASE (page_id + place) % 6 WHEN 0 THEN right(h, length(h) - 1) WHEN 3 THEN right('no url' || href, 40) WHEN 5 THEN 'a.org' ELSE right(h, length(h) - 1) END AS short FROM (SELECT *, regexp_replace(href, '/+$', '') AS h FROM l WHERE regexp_matches(href, '^/[a-z]+/?$'))""")
def link_keys(spark, d):
    n, href = (F.col("page_id") + F.col("place")) % 6, F.col("href")
    forms = [F.concat(F.lit("HTTP://A.org:80/x"), href, F.lit("//?b=2&a=9&ab="), F.col("place").cast("string"), F.lit("&a=1#f")), F.concat(F.lit("https://a.org:80"), href, F.lit("?q=a%26b=1+2%2B")), F.concat(F.lit("http://a.org"), href, F.lit("/?a&=v&")), F.concat(F.lit("no url"), href), F.concat(F.lit("http://a.org/b/../c"), href, F.lit("?#x?y")), F.lit("https://a.org:443/")]
    plain = links(m.table(spark, d, "pages")).filter(href.rlike("^/[a-z]+/?$"))
    u = F.coalesce(*[F.when(n == i, f) for i, f in enumerate(forms)])
    return plain.select("page_id", "place", urls.url_key(u).alias("key"), urls.short_url(u).alias("short"))


@query("""SELECT p_partkey AS product_id, p_partkey % 3 = 0 AS mine, p_partkey % 4 < 2 AS safe FROM part""")
def key_checks(spark, d):
    k = F.col("p_partkey")
    name = k.cast("string")
    key = F.concat(F.when(k % 3 == 1, "other").otherwise(name), F.lit("/"), F.left(F.md5(name.cast("binary")), F.lit(6)), F.when(k % 3 == 2, ".exe").otherwise(".webp"))
    segment = F.when(k % 4 == 2, "..").when(k % 4 == 3, F.concat(F.lit("a/"), name)).otherwise(name)
    return m.table(spark, d, "part").select(k.alias("product_id"), urls.image_key_of(name, key).alias("mine"), urls.safe_segment(segment).alias("safe"))


@query(""", o AS (SELECT DISTINCT order_id, line FROM sizes), new AS (SELECT DISTINCT order_id, unnest([1, 9]) AS line FROM o WHERE order_id % 3 = 0)
SELECT order_id, line, 'stays' AS what FROM o WHERE order_id % 3 <> 0 UNION ALL SELECT order_id, line, 'stays' FROM new UNION ALL SELECT order_id, line, 'removed' FROM o WHERE order_id % 3 = 0 AND line <> 1""")
def replaced_children(spark, d):
    old = m.sizes(spark, d).select("order_id", "line").distinct()
    new = old.filter("order_id % 3 = 0").select("order_id", F.explode(F.array(F.lit(1), F.lit(9))).alias("line")).distinct()
    after, removed = v.replace_children(old, new, "order_id", "line")
    return after.withColumn("what", F.lit("stays")).union(removed.withColumn("what", F.lit("removed")))


@query(_NOTES + " SELECT note, stage, product_id FROM n QUALIFY row_number() OVER (PARTITION BY note, stage ORDER BY product_id, position) = 1")
def first_of_stage(spark, d):
    rows = _notes(spark, d).withColumn("place", F.struct("product_id", "position"))
    return v.first_per_key(rows, ["note", "stage"], "place").select("note", "stage", "product_id")


@query("""SELECT order_id, line, grams, CASE WHEN row_number() OVER (PARTITION BY order_id ORDER BY CASE flag WHEN 'A' THEN 0 ELSE 1 END, line, grams, price) = 1 AND grams % 2 = 0 THEN 40 WHEN grams % 2 = 1 THEN 10 END AS hours FROM sizes""")
def burn_time_fill(spark, d):
    rows = m.sizes(spark, d).select("order_id", "line", "grams", (F.col("flag") == "A").alias("is_primary"), F.struct("line", "grams", "price").alias("place"), F.when(F.col("grams") % 2 == 1, 10).alias("hours"), F.lit(40).alias("all"))
    return v.fill_first_primary(rows, "order_id", "place", "hours", "all").select("order_id", "line", "grams", "hours")


@query("""SELECT doc_id, left(array_to_string(list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]), chr(10)), 300) AS text
FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)""")
def collapsed_lines(spark, d):
    return m.table(spark, d, "documents").filter("text is not null").select("doc_id", v.collapse_lines(F.col("text"), 300).alias("text"))


@query("""SELECT product_id, concat_ws('|', CASE WHEN size > 40 THEN 'large' END, CASE WHEN name LIKE '%bolt%' THEN 'bolt' END, CASE WHEN product_id % 7 = 0 THEN 'seventh' END) AS flags FROM products""")
def product_flags(spark, d):
    rules = {"large": F.col("size") > 40, "bolt": F.col("name").contains("bolt"), "seventh": F.col("product_id") % 7 == 0}
    return v.flagged(m.products(spark, d), rules).select("product_id", F.array_join("flags", "|").alias("flags"))


@query("SELECT event_type || '_seconds' AS name, round(sum(event_id % 100 / 4.0), 3) AS seconds FROM events GROUP BY 1")
def stage_seconds(spark, d):
    timing = F.create_map(F.concat("event_type", F.lit("_seconds")), (F.col("event_id") % 100) / 4.0, F.lit("items"), F.lit(1.0))
    return v.stage_seconds(m.table(spark, d, "events").select(timing.alias("timing")))


@query("""SELECT regexp_replace(url, '[?#].*$', '') AS url, max(page_id % 17) AS score FROM pages WHERE url IS NOT NULL GROUP BY 1 ORDER BY score DESC, url LIMIT 20""")
def best_links(spark, d):
    """The twenty best links: the limit is the feature."""
    return v.best_links(m.table(spark, d, "pages").filter("url is not null").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), (F.col("page_id") % 17).alias("score")), 20)


@query("SELECT product_id, line, 'https://img.org/a/' || product_id || '/' || line AS url, flag = 'A' AS is_primary FROM sizes")
def public_images(spark, d):
    key = F.concat_ws("/", F.col("product_id").cast("string"), F.col("line").cast("string"))
    return m.sizes(spark, d).select("product_id", "line", v.public_image(key, F.when(F.col("flag") == "A", 1).otherwise(0), "https://img.org/a/").alias("x")).select("product_id", "line", "x.*")
