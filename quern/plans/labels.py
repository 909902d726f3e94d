"""Queries of labels, profiles, pairing and guarded updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, text
from ..operators import views as v
from . import model as m
from .queries import _SLUG, query


@query("""SELECT user_id, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'rejected') AS rejected, count(*) AS total
FROM (SELECT * FROM reviews QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created DESC, review_id) <= 5) GROUP BY 1""")
def review_profile(spark, d):
    rows = v.newest(m.reviews(spark, d), "user_id", [F.col("created").desc(), F.col("review_id")], 5)
    return v.status_profile(rows, "user_id", ["approved", "pending", "rejected"])


@query("SELECT user_id, vote_id FROM votes QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY vote_id DESC) <= 4")
def log_tail(spark, d):
    return v.newest(m.votes(spark, d), "user_id", [F.col("vote_id").desc()], 4).select("user_id", "vote_id")


@query("""SELECT a.order_id, a.line AS line_a, b.line AS line_b FROM (SELECT order_id, line, row_number() OVER (PARTITION BY order_id ORDER BY grams, line) AS r FROM sizes WHERE line <= 3) a
JOIN (SELECT order_id, line, row_number() OVER (PARTITION BY order_id ORDER BY price DESC, line) AS r FROM sizes) b ON a.order_id = b.order_id AND a.r = b.r""")
def paired_files(spark, d):
    s = m.sizes(spark, d)
    one, other = s.filter("line <= 3").withColumnRenamed("line", "line_a").select("order_id", "grams", "line_a"), s.select("order_id", "price", F.col("line").alias("line_b"))
    return v.paired_by_place(one, other, "order_id", ["grams", "line_a"], [F.desc("price"), "line_b"]).select("order_id", "line_a", "line_b")


@query("""SELECT order_id AS page, line AS ord, flag AS tag, row_number() OVER (PARTITION BY order_id, flag ORDER BY line, product_id, price) AS nth FROM sizes""")
def nth_of_type(spark, d):
    nodes = m.sizes(spark, d).select(F.col("order_id").alias("page"), F.lit(0).alias("parent"), F.col("flag").alias("tag"), F.struct("line", "product_id", "price").alias("ord"))
    return v.nth_of_type(nodes).select("page", F.col("ord.line").alias("ord"), "tag", "nth")


@query("""SELECT product_id AS key, 'bolt' AS word FROM products WHERE name LIKE '%bolt%' UNION ALL SELECT product_id, 'brand-1' FROM products WHERE product_id % 2 = 0 AND brand_slug LIKE '%brand-1%'""")
def keys_for_only(spark, d):
    p = m.products(spark, d).select(F.col("product_id").alias("key"), "name", F.lit("").alias("url"))
    raw = m.products(spark, d).filter("product_id % 2 = 0").select(F.col("product_id").alias("key"), F.lit("").alias("name"), F.col("brand_slug").alias("url"))
    return v.named_or_raw(p, raw, "BOLT").withColumn("word", F.lit("bolt")).union(v.named_or_raw(p, raw, "Brand-1").withColumn("word", F.lit("brand-1")))


@query("""SELECT vote_id, option, CASE option WHEN 'click' THEN 1 WHEN 'view' THEN 2 END AS option_id, CASE WHEN option NOT IN ('click', 'view') THEN 'unknown option: act/' || option END AS error FROM votes""")
def resolved_options(spark, d):
    options = spark.createDataFrame([("act", "click", 1), ("act", "view", 2)], "dimension string, option string, option_id int")
    wanted = m.votes(spark, d).select("vote_id", F.lit("act").alias("dimension"), "option")
    return v.resolve(wanted, options, ["dimension", "option"], "option_id").select("vote_id", "option", "option_id", "error")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new@x.org' ELSE 'old@x.org' END AS email, c_custkey % 3 = 0 AS changed FROM customer""")
def guarded_update(spark, d):
    rows = m.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old@x.org").alias("email"))
    k = F.col("id") % 3
    changes = rows.filter(k != 2).select("id", F.when(k == 0, "new@x.org").when(F.col("id") % 2 == 0, "old@x.org").alias("email"))
    return v.guarded_update(rows, changes, "id", "email")


@query("""SELECT url, min(t) AS technique FROM (SELECT p_brand AS url, 0 AS t FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT p_brand, 1 FROM part WHERE p_partkey % 2 = 0) GROUP BY 1""")
def discovery_order(spark, d):
    p = m.table(spark, d, "part").select(F.col("p_brand").alias("url"), "p_partkey")
    none, far = p.filter("p_partkey < 0"), p.filter("p_partkey % 2 = 0")
    found = v.techniques([p.filter("p_partkey % 9 = 0"), far, none], 1_000_000)
    return found


@query(f"""SELECT line, order_id, grams, printf('£%.2f', price / 100) AS price, lower(flag) || ' -#.#' AS kind, flag || chr(10) || '  ' || chr(10) || ' ' || line AS raw,
CASE WHEN grams > 25 THEN 'size: too large; one bad line' ELSE 'one bad line' END AS issues, CASE WHEN line > 3 THEN flag || ' ' ELSE ' p' || line END AS source, CASE WHEN price % 100 = 0 THEN price // 100 ELSE -1 END AS minor FROM sizes""")
def record_labels(spark, d):
    line, grams = F.col("line").cast("string"), F.col("grams").cast("string")
    bad = F.array_compact(F.array(F.when(F.col("grams") > 25, F.struct(F.lit("size").alias("path"), F.lit("too large").alias("message"))), F.struct(F.lit("").alias("path"), F.lit("one bad line").alias("message"))))
    amount = F.when(F.col("price") % 100 == 0, (F.col("price") / 100).cast("long").cast("string")).otherwise("x1.5")
    return m.sizes(spark, d).select(
        "line", "order_id", "grams", labels.plain_price(F.col("price")).alias("price"), labels.type_value(F.concat(F.lit(" "), "flag", F.lit(" \n -"), line, F.lit("."), grams)).alias("kind"),
        labels.joined_values(F.array(F.col("flag"), F.lit("  "), F.concat(F.lit(" "), line))).alias("raw"), labels.issues_line(bad).alias("issues"),
        labels.first_text(F.when(F.col("line") > 3, F.concat("flag", F.lit(" "))).otherwise(" "), F.array(F.lit(""), F.concat(F.lit(" p"), line))).alias("source"),
        labels.whole_minor_units(amount, F.lit("GBP"), F.lit(-1).cast("long")).alias("minor"),
    )


@query(f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M-%SZ') AS run, CASE WHEN length(trim(props)) >= 10 THEN props WHEN event_id % 3 = 0 THEN coalesce(props, '') ELSE event_type END AS body, [event_type] AS listed FROM events""")
def event_labels(spark, d):
    e = m.table(spark, d, "events")
    return e.select("event_id", labels.run_id(F.col("ts")).alias("run"), labels.long_enough(F.col("props"), F.when(F.col("event_id") % 3 == 0, " \n").otherwise(F.col("event_type")), 10).alias("body"), labels.listed(F.col("event_type")).alias("listed"))


@query(f"""SELECT p_partkey AS product_id, unnest(list_transform(string_split(p_name, ' '), lambda x, i: x || '|' || CASE WHEN i = 1 THEN 'given' ELSE {_SLUG.format('x')} END || '|' || CASE WHEN i = 2 THEN 'top' ELSE 'unknown' END)) AS note FROM part""")
def zipped_notes(spark, d):
    names = F.split("p_name", " ")
    notes = labels.zipped_names(names, F.array(F.lit(" "), F.lit("top")), F.array(F.lit("given")), text.slugify)
    return m.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.explode(F.transform(notes, lambda n: F.concat_ws("|", n["name"], n["slug"], n["stage"]))).alias("note"))
