"""One query for each operator group of the catalogue, with the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..operators import catalogue as c
from ..streaming import votes as streams
from . import model as m

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {MODEL}{sql}" if sql.startswith(",") else f"WITH {MODEL}\n{sql}"
        return f

    return put


_SLUG = "regexp_replace(regexp_replace(trim(lower({0})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
MODEL = f"""products AS (SELECT p_partkey AS product_id, p_name AS name, p_brand AS brand, {_SLUG.format('p_brand')} AS brand_slug, {_SLUG.format('p_type')} AS category_slug, p_size AS size FROM part),
ratings AS (SELECT l_partkey AS product_id, sum(l_quantity::BIGINT % 5 + 1)::DOUBLE / count(*) AS rating_avg, count(*) AS rating_count FROM lineitem GROUP BY 1),
notes AS (SELECT DISTINCT p_partkey AS product_id, unnest(string_split(lower(p_name), ' ')) AS note FROM part),
votes AS (SELECT user_id, event_id % 200 AS product_id, event_type AS option, ts, event_id AS vote_id FROM events),
last_votes AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, vote_id DESC) = 1),
counts AS (SELECT product_id, option, count(*) AS votes FROM last_votes GROUP BY 1, 2),
sizes AS (SELECT l_partkey AS product_id, l_orderkey AS order_id, l_linenumber AS line, l_quantity::INT AS grams, round(l_extendedprice * 100)::BIGINT AS price, l_returnflag AS flag FROM lineitem),
reviews AS (SELECT o_orderkey AS review_id, o_custkey AS user_id, o_orderkey % 200 AS product_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending' ELSE 'rejected' END AS status, o_orderdate AS created FROM orders)"""


def _latest(votes):
    return c.latest(votes, ["user_id", "product_id"], [F.col("ts").desc(), F.col("vote_id").desc()])


def _counts(spark, d):
    return c.vote_counts(_latest(m.votes(spark, d)))


def _facet(spark, d, **chosen):
    f = c.Filters(**chosen)
    return c.facet(m.products(spark, d), f, m.ratings(spark, d), m.notes(spark, d), _counts(spark, d)), f


@query("SELECT product_id, name FROM products WHERE brand_slug = 'brand-12' OR brand_slug = 'brand-13'")
def facet_brand(spark, d):
    one, _ = _facet(spark, d, brand="brand-12")
    two, _ = _facet(spark, d, brand="brand-13")
    return one.union(two).select("product_id", "name")


@query("SELECT product_id, name, rating_avg FROM products JOIN ratings USING (product_id) WHERE rating_avg >= 3.1")
def facet_min_rating(spark, d):
    return _facet(spark, d, min_rating=3.1)[0].select("product_id", "name", "rating_avg")


@query("SELECT product_id, name FROM products SEMI JOIN (SELECT product_id FROM notes WHERE note IN ('red', 'blue', 'green', 'almond', 'small')) USING (product_id)")
def facet_notes_any(spark, d):
    return _facet(spark, d, notes=["red", "blue", "green", "almond", "small"])[0].select("product_id", "name")


@query("SELECT product_id, name FROM products WHERE product_id IN (SELECT product_id FROM counts WHERE option = 'click') AND product_id IN (SELECT product_id FROM counts WHERE option = 'purchase')")
def facet_votes_all(spark, d):
    return _facet(spark, d, votes=["click", "purchase"])[0].select("product_id", "name")


@query("SELECT product_id, name, rating_avg FROM products LEFT JOIN ratings USING (product_id) ORDER BY rating_avg DESC NULLS LAST, product_id LIMIT 20 OFFSET 40")
def facet_page(spark, d):
    found, f = _facet(spark, d, sort="rating", offset=40)
    return c.page(found, f).select("product_id", "name", "rating_avg")


@query("SELECT CASE WHEN upper(left(name, 1)) BETWEEN 'A' AND 'Z' THEN upper(left(name, 1)) ELSE '#' END AS letter, count(*) AS n FROM products GROUP BY 1")
def brand_letters(spark, d):
    return c.letters(m.products(spark, d), "name")


@query("SELECT count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected FROM reviews")
def review_counts(spark, d):
    return m.reviews(spark, d).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "pending", "rejected")])


@query("SELECT product_id, option, votes, floor(100.0 * votes / sum(votes) OVER (PARTITION BY product_id) + 0.5)::INT AS pct FROM counts")
def vote_aggregates(spark, d):
    return c.shares(_counts(spark, d), "product_id", "votes")


@query("SELECT user_id, product_id, option FROM last_votes")
def upsert_latest_vote(spark, d):
    return _latest(m.votes(spark, d)).select("user_id", "product_id", "option")


@query("SELECT user_id, product_id, option FROM last_votes")
def votes_keyed_state(spark, d):
    return streams.latest_votes(m.votes(spark, d))


@query("SELECT s AS stars, count(*) FILTER (r = s) AS n, floor(100.0 * count(*) FILTER (r = s) / count(*) + 0.5)::INT AS pct FROM (SELECT l_quantity::BIGINT % 5 + 1 AS r FROM lineitem), range(1, 6) AS o(s) GROUP BY s")
def rating_distribution(spark, d):
    r = m.table(spark, d, "lineitem").select((F.col("l_quantity").cast("long") % 5 + 1).alias("rating"))
    return c.rating_distribution(r).withColumn("stars", F.col("stars").cast("long"))


@query("""SELECT bucket, n, floor(100.0 * n / sum(n) OVER () + 0.5)::INT AS pct FROM (SELECT 'active' AS bucket, sum(votes)::BIGINT AS n FROM counts WHERE option IN ('click', 'purchase')
UNION ALL SELECT 'passive', sum(votes)::BIGINT FROM counts WHERE option IN ('view', 'signup') UNION ALL SELECT 'never', 0)""")
def day_night_buckets(spark, d):
    return c.buckets(_counts(spark, d), "option", "votes", {"active": ["click", "purchase"], "passive": ["view", "signup"], "never": ["none"]})


@query("""SELECT product_id, name, coalesce(n, 0) AS n_notes, coalesce(v, 0) AS n_votes, coalesce(s, 0) AS n_sizes FROM products
LEFT JOIN (SELECT product_id, count(*) AS n FROM notes GROUP BY 1) USING (product_id) LEFT JOIN (SELECT product_id, count(*) AS v FROM counts GROUP BY 1) USING (product_id)
LEFT JOIN (SELECT product_id, count(*) AS s FROM sizes GROUP BY 1) USING (product_id)""")
def product_detail_counts(spark, d):
    full = c.documents(m.products(spark, d), notes=m.notes(spark, d), votes=_counts(spark, d), sizes=m.sizes(spark, d).select("product_id", "order_id", "line"))
    return full.select("product_id", "name", *[F.size(x).cast("long").alias(f"n_{x}") for x in ("notes", "votes", "sizes")])


@query("SELECT product_id, array_to_string(list_sort(list(note)), '|') AS notes FROM notes GROUP BY 1")
def product_documents(spark, d):
    full = c.documents(m.products(spark, d), notes=m.notes(spark, d))
    return full.select("product_id", F.array_join("notes.note", "|").alias("notes"))


@query("SELECT product_id, arg_min(price, (price, order_id, line)) AS price, arg_min(order_id, (price, order_id, line)) AS order_id, max(grams) AS grams FROM sizes GROUP BY 1")
def cheapest_size(spark, d):
    s, order = m.sizes(spark, d), F.struct("price", "order_id", "line")
    return s.groupBy("product_id").agg(F.min("price").alias("price"), F.min_by("order_id", order).alias("order_id"), F.max("grams").alias("grams"))


@query("SELECT product_id, arg_min(order_id, (flag <> 'R', order_id, line)) AS order_id, bool_or(flag = 'R') AS flagged FROM sizes GROUP BY 1")
def primary_size(spark, d):
    s = m.sizes(spark, d)
    return s.groupBy("product_id").agg(F.min_by("order_id", F.struct(F.col("flag") != "R", "order_id", "line")).alias("order_id"), F.bool_or(F.col("flag") == "R").alias("flagged"))


@query("""SELECT product_id, related_id, row_number() OVER (PARTITION BY product_id ORDER BY n)::INT AS rank FROM (SELECT p.product_id, r.product_id AS related_id, r.n FROM products p
JOIN (SELECT *, row_number() OVER (PARTITION BY brand_slug ORDER BY name, product_id) AS n FROM products QUALIFY n <= 8) r USING (brand_slug) WHERE p.product_id <> r.product_id) QUALIFY rank <= 5""")
def related_products(spark, d):
    return c.related(m.products(spark, d))


@query("""SELECT status, country, count(*) AS n FROM reviews JOIN products USING (product_id) LEFT JOIN (SELECT c_custkey AS user_id, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey) USING (user_id) GROUP BY 1, 2""")
def admin_reviews(spark, d):
    users = m.table(spark, d, "customer").join(F.broadcast(m.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("country"))
    return m.reviews(spark, d).join(m.products(spark, d).select("product_id"), "product_id").join(users, "user_id", "left").groupBy("status", "country").agg(F.count("*").alias("n"))


@query("SELECT user_id, product_id, arg_max(review_id, (created, review_id)) AS review_id, min(review_id) AS kept_id, count(*) AS submissions FROM reviews GROUP BY 1, 2")
def resubmit_review(spark, d):
    r = m.reviews(spark, d)
    return r.groupBy("user_id", "product_id").agg(F.max_by("review_id", F.struct("created", "review_id")).alias("review_id"), F.min("review_id").alias("kept_id"), F.count("*").alias("submissions"))


@query("SELECT product_id FROM products ANTI JOIN (SELECT product_id FROM reviews WHERE status = 'approved') USING (product_id)")
def anti_backfill(spark, d):
    return m.products(spark, d).join(m.reviews(spark, d).filter("status = 'approved'"), "product_id", "left_anti").select("product_id")


@query("SELECT * FROM (SELECT product_id, name, 'old' AS origin FROM products WHERE product_id % 3 <> 0 UNION ALL SELECT product_id, upper(name), 'new' FROM products WHERE product_id % 3 = 0 OR product_id % 7 = 0) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY origin) = 1")
def merge_products(spark, d):
    p = m.products(spark, d).select("product_id", "name")
    old = p.filter("product_id % 3 <> 0").select("*", F.lit("old").alias("origin"), F.lit(0).alias("seq"))
    new = p.filter("product_id % 3 = 0 or product_id % 7 = 0").select("product_id", F.upper("name").alias("name"), F.lit("new").alias("origin"), F.lit(1).alias("seq"))
    return c.merge(old, new, "product_id").drop("seq")


@query("SELECT brand_slug, count(*) AS n, min(product_id) AS first_item, max(product_id) AS last_item FROM products GROUP BY 1 HAVING count(*) > 1")
def duplicate_findings(spark, d):
    return c.duplicates(m.products(spark, d), "brand_slug", "product_id")


@query("""SELECT lower(b) AS key, arg_min(b, (b = upper(b), id)) AS name, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS b, p_partkey AS id FROM part) GROUP BY 1""")
def dedupe_brands(spark, d):
    p = m.table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("b"), F.col("p_partkey").alias("id"))
    return c.dedupe_spellings(p.withColumn("name", text.brand_line(F.col("b"))), "name", "id", text.is_all_caps)


@query("""SELECT product_id, grams, arg_min(position, (price IS NULL, position)) AS position, arg_min(price, position) FILTER (price IS NOT NULL) AS price, count(*) FILTER (is_primary) > 0 AS is_primary
FROM (SELECT product_id, grams, order_id * 10 + line AS position, CASE WHEN flag = 'N' THEN NULL ELSE price END AS price, flag = 'R' AS is_primary FROM sizes) GROUP BY 1, 2""")
def dedupe_sizes(spark, d):
    s = m.sizes(spark, d).select("product_id", "grams", (F.col("order_id") * 10 + F.col("line")).alias("position"), F.when(F.col("flag") != "N", F.col("price")).alias("price"), F.lit(None).cast("string").alias("sku"), (F.col("flag") == "R").alias("is_primary"))
    return c.dedupe_sizes(s).drop("sku")


@query("""SELECT CASE WHEN name = '' THEN 'failed' WHEN product_id % 4 = 0 THEN 'created' WHEN product_id % 5 = 0 THEN 'updated' ELSE 'skipped' END AS status, count(*) AS n FROM products GROUP BY 1""")
def import_status(spark, d):
    p = m.products(spark, d)
    incoming = p.select("product_id", F.sha2(F.col("name").cast("binary"), 256).alias("hash"))
    known = p.filter("product_id % 4 <> 0").select("product_id", F.when(F.col("product_id") % 5 == 0, "old").otherwise(F.sha2(F.col("name").cast("binary"), 256)).alias("hash"))
    return c.import_status(incoming, known, "product_id", lambda a, b: a != b).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents) WHERE token <> '' GROUP BY 1, 2")
def fts_index(spark, d):
    return c.tokens(m.table(spark, d, "documents"), "doc_id", "text")


@query("""SELECT doc_id, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS token FROM documents) WHERE token IN ('the', 'with', 'from') GROUP BY 1 HAVING count(DISTINCT token) = 3""")
def fts_and_search(spark, d):
    return c.search(c.tokens(m.table(spark, d, "documents"), "doc_id", "text"), "doc_id", ["the", "with", "from"])


@query(f"SELECT p_partkey AS product_id, {_SLUG.format('p_name')} AS slug, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS compact FROM part")
def slugify_all(spark, d):
    return m.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), text.slugify(F.col("p_name")).alias("slug"), text.compact_key(F.col("p_type")).alias("compact"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 2)) || regexp_replace(lower(regexp_extract(url, '^([^:/?#]+)://([^/?#]*)([^?#]*)', 3)), '/+$', '') AS product_key, left(sha256(url), 12) AS hash FROM pages""")
def url_keys(spark, d):
    url = F.col("url")
    return m.table(spark, d, "pages").select("page_id", urls.product_key(url).alias("product_key"), urls.url_hash(url).alias("hash"))


@query("""SELECT doc_id, length(trim(text)) < 40 OR (len(l) >= 12 AND len(list_filter(l, lambda x: length(x) < 28)) >= 0.55 * len(l)) AS noisy
FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def noisy_text(spark, d):
    return m.table(spark, d, "documents").select("doc_id", text.noisy_description(F.col("text")).alias("noisy"))


@query("SELECT product_id, '#' || lpad(printf('%x', ('0x' || substr(md5(name), 1, 2))::INT // 2 + 80), 2, '0') || lpad(printf('%x', ('0x' || substr(md5(name), 3, 2))::INT // 2 + 80), 2, '0') || lpad(printf('%x', ('0x' || substr(md5(name), 5, 2))::INT // 2 + 80), 2, '0') AS color FROM products")
def fallback_color(spark, d):
    return m.products(spark, d).select("product_id", text.fallback_color(F.col("name")).alias("color"))


@query("SELECT c_custkey AS user_id, floor(c_acctbal + 0.5)::BIGINT AS rounded, CASE WHEN printf('%.2f', c_acctbal) LIKE '%.%' THEN floor(printf('%.2f', c_acctbal)::DOUBLE * 100 + 0.5)::DOUBLE END AS minor FROM customer")
def js_round(spark, d):
    money = F.format_string("%.2f", "c_acctbal")
    return m.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), numbers.round_half_up(F.col("c_acctbal")).alias("rounded"), numbers.currency_of(money).alias("minor"))


@query("SELECT product_id, size::DOUBLE AS value, 'oz' AS unit, round_even(size * 28.3495, 0)::INT AS grams FROM products")
def size_parse(spark, d):
    s = numbers.size_of(F.concat(F.lit("Candle "), F.col("size").cast("string"), F.lit(" oz jar")))
    return m.products(spark, d).select("product_id", s.alias("s")).select("product_id", "s.value", "s.unit", "s.grams")


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1")
def session_activity(spark, d):
    found = streams.sessions(m.table(spark, d, "events"))
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query()
def unique_slugs(spark, d):
    p = m.products(spark, d).select("product_id", F.col("category_slug").alias("site"), F.col("brand_slug").alias("slug"), F.col("product_id").alias("position"))
    return c.unique_slugs(p)
