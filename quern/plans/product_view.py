"""The whole product document as a query over the driver's tables: parts with seven child tables, events as votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.product_view import product_view as view
from . import model as m
from .queries import query

_PRICE = "(CASE coalesce({1}, 'GBP') WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' WHEN 'USD' THEN 'US$' END || format('{{:,}}', {0} // 100) || CASE WHEN {0} % 100 = 0 THEN '' ELSE '.' || lpad(({0} % 100)::VARCHAR, 2, '0') END)"
_NUMBER = "(CASE WHEN {0} = floor({0}) THEN floor({0})::BIGINT::VARCHAR ELSE {0}::VARCHAR END)"
_PCT = "(CASE WHEN {1} = 0 THEN 0 ELSE floor({0} * 100.0 / {1} + 0.5) END)::INT"
_ROWS = """, prod AS (SELECT *, CASE WHEN product_id % 3 = 0 THEN 'About ' || name END AS description, CASE WHEN product_id % 2 = 0 THEN 'soy' END AS wax_type,
  CASE WHEN product_id % 5 > 0 THEN 'glass' END AS vessel, CASE WHEN product_id % 7 > 0 THEN 1970 + size END AS release_year, CASE WHEN product_id % 11 > 0 THEN brand_slug END AS brand_id FROM products WHERE product_id % 13 > 0),
house AS (SELECT brand_slug AS brand_id, min(brand) AS brand, CASE WHEN right(brand_slug, 1) <> '2' THEN 'https://www.' || brand_slug || '.test/' END AS site, CASE WHEN right(brand_slug, 1) <> '3' THEN 'Country ' || right(brand_slug, 1) END AS country FROM products GROUP BY brand_slug),
words AS (SELECT p_partkey AS product_id, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part),
kinds AS (SELECT p_partkey AS product_id, unnest(string_split(p_type || ' ' || p_name, ' ')) AS word, generate_subscripts(string_split(p_type || ' ' || p_name, ' '), 1) - 1 AS place FROM part),
fam AS (SELECT product_id, word, place, CASE WHEN product_id % 5 = 0 THEN 'top' WHEN product_id % 5 = 1 THEN 'Heart' WHEN product_id % 5 = 2 THEN 'BASE' WHEN product_id % 5 = 3 AND place = 0 THEN 'middle' END AS stage,
  CASE WHEN place = 2 THEN 'linear ' || word WHEN place = 0 AND product_id % 2 = 0 THEN '#112233' ELSE CASE product_id % 4 WHEN 0 THEN '#8b7355' WHEN 1 THEN '#d4a0b8' ELSE '#d5cbbf' END END AS color FROM words),
staged AS (SELECT *, CASE lower(stage) WHEN 'top' THEN 1 WHEN 'middle' THEN 2 WHEN 'heart' THEN 2 WHEN 'base' THEN 3 ELSE 4 END AS s FROM fam),
pyr AS (SELECT product_id, string_agg(g, '|' ORDER BY s) AS pyramid FROM (SELECT product_id, s, ['Top', 'Heart', 'Base', 'Other'][s] || ':' || string_agg(word || ' ' || color, ',' ORDER BY place, word) AS g FROM staged GROUP BY 1, 2) GROUP BY 1),
acc AS (SELECT product_id, word, place, CASE place WHEN 1 THEN (product_id % 100)::INT WHEN 2 THEN 50 END AS pct, CASE WHEN place = 1 THEN '#abcdef' ELSE '#d5cbbf' END AS color FROM kinds),
acs AS (SELECT product_id, string_agg(concat_ws(' ', word, color, pct), ',' ORDER BY coalesce(pct, -1) DESC, place, word) AS accords, string_agg(word || ' ' || color, ',' ORDER BY place, word) FILTER (place < 5) AS accord_chips,
  string_agg(word, ' · ' ORDER BY place, word) FILTER (place < 2) AS scent_type FROM acc GROUP BY 1),
cast_votes AS (SELECT event_id % 200 AS product_id, CASE event_id % 6 WHEN 0 THEN 'season' WHEN 3 THEN 'season' WHEN 1 THEN 'time_of_day' WHEN 4 THEN 'time_of_day' WHEN 2 THEN 'sillage' ELSE 'longevity' END AS dim, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3),
dims AS (SELECT product_id, dim, sum(n) AS total FROM cast_votes WHERE dim IN ('sillage', 'longevity') GROUP BY 1, 2),
dv AS (SELECT product_id, string_agg(g, '|' ORDER BY dim) AS votes FROM (SELECT product_id, dim, 'The ' || dim || ' ' || any_value(total)::BIGINT || ':' || string_agg(upper(event_type) || ' ' || """ + _PCT.format("n", "total") + """, ',' ORDER BY length(event_type), event_type) AS g FROM cast_votes JOIN dims USING (product_id, dim) GROUP BY 1, 2) GROUP BY 1),
sv AS (SELECT product_id, coalesce(sum(n) FILTER (dim = 'season'), 0) AS st, coalesce(sum(n) FILTER (dim = 'time_of_day'), 0) AS tt, """ + ", ".join(f"coalesce(sum(n) FILTER (dim = 'season' AND event_type = '{e}'), 0) AS {s}" for e, s in (("click", "spring"), ("view", "summer"), ("signup", "autumn"), ("purchase", "winter"))) + """,
  coalesce(sum(n) FILTER (dim = 'time_of_day' AND event_type IN ('click', 'view')), 0) AS dd, coalesce(sum(n) FILTER (dim = 'time_of_day' AND event_type IN ('signup', 'purchase')), 0) AS nn FROM cast_votes GROUP BY 1),
sz AS (SELECT product_id, order_id * 10 + line AS size_id, line AS position, flag = 'R' AS is_primary, CASE WHEN order_id % 5 > 0 THEN grams END AS g, CASE WHEN order_id % 3 = 0 THEN grams / 2.0 END AS v, CASE WHEN line <> 2 THEN grams END AS burn,
  CASE WHEN order_id % 7 > 0 THEN price END AS price, CASE line % 3 WHEN 1 THEN 'EUR' WHEN 2 THEN 'USD' END AS currency,
  CASE order_id % 4 WHEN 1 THEN 'https://www.brand-11.test/' WHEN 2 THEN 'https://www.shop' || order_id % 3 || '.test/p/' || product_id WHEN 3 THEN 'no url' END AS url FROM sizes),
one AS (SELECT * FROM sz QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY NOT is_primary, position, g NULLS FIRST, size_id) = 1),
cheap AS (SELECT * FROM sz WHERE price IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, position, NOT is_primary, g NULLS FIRST, size_id) = 1),
shop AS (SELECT s.*, row_number() OVER (PARTITION BY s.product_id ORDER BY position, NOT is_primary, g NULLS FIRST, size_id) AS nth FROM (SELECT * FROM sz WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY product_id, url ORDER BY position, NOT is_primary, g NULLS FIRST, size_id, price NULLS FIRST) = 1) s
  JOIN prod USING (product_id) LEFT JOIN house USING (brand_id) WHERE url IS DISTINCT FROM site),
shops AS (SELECT product_id, string_agg(concat_ws(' ', CASE WHEN url = 'no url' THEN 'Stockist' WHEN url LIKE '%brand-11%' THEN 'Brand-11' ELSE 'Shop' || url[17] END, 'Stockist', """ + _PRICE.format("price", "currency") + """, url), ',' ORDER BY nth) AS shops FROM shop GROUP BY 1),
alike AS (SELECT product_id, string_agg(concat_ws(' ', CASE WHEN line <> 1 THEN 'Candle ' || order_id ELSE 'Linked candle' END, ['olive', 'espresso', 'oxblood', 'stone'][nth]), ',' ORDER BY nth) AS similar_to FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY CASE WHEN line <> 3 THEN grams END DESC NULLS LAST, order_id * 10 + line) AS nth FROM sizes) WHERE nth <= 4 GROUP BY 1),
rev AS (SELECT *, CASE WHEN review_id % 6 > 0 THEN user_id % 5 + 1 END AS stars, CASE WHEN review_id % 3 > 0 THEN created END AS published FROM reviews WHERE status = 'approved'),
shown AS (SELECT product_id, string_agg(concat_ws(' ', CASE WHEN review_id % 4 = 0 THEN 'Anonymous' ELSE 'U' || user_id END, stars, 'Order ' || review_id), ',' ORDER BY nth) AS reviews FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY published DESC NULLS LAST, created DESC, review_id) AS nth FROM rev) WHERE nth <= 6 GROUP BY 1),
rated AS (SELECT product_id, avg(stars) AS a, count(*) AS n, """ + " || ',' || ".join(f"'{s} ' || " + _PCT.format(f"count(*) FILTER (stars = {s})", "count(*)") for s in range(5, 0, -1)) + """ AS dist FROM rev WHERE stars IS NOT NULL GROUP BY 1)
SELECT product_id, p.name, h.brand, h.brand_id AS brand_slug, h.country AS brand_country, scent_type, p.release_year::INT AS year, """ + _PRICE.format("c.price", "c.currency") + """ AS from_price, coalesce(p.description, 'In a word: ' || p.category_slug) AS summary,
round(coalesce(a, CASE WHEN product_id % 2 = 0 THEN rating_avg END), 6) AS rating_avg, coalesce(n, CASE WHEN product_id % 2 = 0 THEN rating_count END, 0)::BIGINT AS rating_count, coalesce(pyramid, '') AS pyramid, coalesce(accords, '') AS accords, coalesce(accord_chips, '') AS accord_chips, coalesce(votes, '') AS votes,
""" + " || ',' || ".join(f"'{s.capitalize()} {s} ' || coalesce({s}, 0)::BIGINT || ' ' || coalesce(" + _PCT.format(s, "st") + ", 0)" for s in ("spring", "summer", "autumn", "winter")) + """ AS seasons,
'Day day ' || coalesce(dd, 0)::BIGINT || ' ' || coalesce(""" + _PCT.format("dd", "tt") + """, 0) || ',Night night ' || coalesce(nn, 0)::BIGINT || ' ' || coalesce(""" + _PCT.format("nn", "tt") + """, 0) AS day_night,
concat_ws(',', 'Burn time ' || o.burn || ' hrs', 'Weight ' || coalesce(""" + _NUMBER.format("o.v") + """ || 'oz', o.g || 'g'), 'Wax type ' || p.wax_type, 'Vessel ' || p.vessel, 'Released ' || p.release_year, 'Made in ' || h.country) AS specs,
concat_ws(',', CASE WHEN site IS NOT NULL THEN concat_ws(' ', h.brand, 'The house', """ + _PRICE.format("c.price", "c.currency") + """, site) END, shops) AS stockists, coalesce(similar_to, '') AS similar, coalesce(shown.reviews, '') AS reviews, dist AS rating_dist
FROM prod p LEFT JOIN house h ON p.brand_id = h.brand_id LEFT JOIN pyr USING (product_id) LEFT JOIN acs USING (product_id) LEFT JOIN dv USING (product_id) LEFT JOIN sv USING (product_id) LEFT JOIN shops USING (product_id) LEFT JOIN alike USING (product_id)
LEFT JOIN shown USING (product_id) LEFT JOIN rated USING (product_id) LEFT JOIN one o USING (product_id) LEFT JOIN cheap c USING (product_id) LEFT JOIN ratings USING (product_id)"""


def _tables(spark, d):
    """The eleven tables of a product view, by argument, from parts, line items, orders and events."""
    k, place, parts = F.col("product_id"), F.col("position_index"), m.products(spark, d)
    last = F.right("brand_slug", F.lit(1))
    products = parts.select(
        "product_id", "name", F.col("category_slug").alias("category_id"), F.when(k % 11 > 0, F.col("brand_slug")).alias("brand_id"), F.when(k % 3 == 0, F.concat(F.lit("About "), "name")).alias("description"),
        F.when(k % 2 == 0, "soy").alias("wax_type"), F.when(k % 5 > 0, "glass").alias("vessel_material"), F.when(k % 7 > 0, F.col("size") + 1970).alias("release_year"),
    ).withColumn("category_id", F.when(k % 13 > 0, F.col("category_id")))
    brands = parts.groupBy("brand_slug").agg(F.min("brand").alias("name")).select(F.col("brand_slug").alias("brand_id"), "name", F.col("brand_slug").alias("slug"), F.when(last != "3", F.concat(F.lit("Country "), last)).alias("country"), F.when(last != "2", F.concat(F.lit("https://www."), "brand_slug", F.lit(".test/"))).alias("website_url"))
    rows = m.table(spark, d, "part").withColumnRenamed("p_partkey", "product_id")
    stage = F.when(k % 5 == 0, "top").when(k % 5 == 1, "Heart").when(k % 5 == 2, "BASE").when((k % 5 == 3) & (place == 0), "middle")
    family = F.when(k % 4 == 0, "Dry Woody").when(k % 4 == 1, "Green floral").when(k % 4 == 2, "none")
    notes = rows.select("product_id", F.posexplode(F.split("p_name", " ")).alias("position_index", "name"))
    notes = notes.select("*", stage.alias("pyramid_stage"), F.when((place == 0) & (k % 2 == 0), "#112233").when(place == 1, "").alias("color"), F.when(place == 2, F.concat(F.lit("linear "), "name")).alias("color_gradient"), family.alias("note_family"))
    accords = rows.select("product_id", F.posexplode(F.split(F.concat_ws(" ", "p_type", "p_name"), " ")).alias("position_index", "name"))
    accords = accords.select("*", F.when(place == 1, k % 100 / 100.0).when(place == 2, F.lit(0.5)).alias("strength_score"), F.when(place == 1, "#abcdef").alias("color"), F.lit(None).cast("string").alias("note_family"))
    e, kind = F.col("event_id"), F.col("event_type")
    dimension = F.when(e % 3 == 0, "season").when(e % 3 == 1, "time_of_day").when(e % 6 == 2, "sillage").otherwise("longevity")
    season = F.when(kind == "click", "spring").when(kind == "view", "summer").when(kind == "signup", "autumn").when(kind == "purchase", "winter")
    hour = F.when(kind == "click", "morning").when(kind == "view", "day").when(kind == "signup", "evening").when(kind == "purchase", "night")
    counted = m.table(spark, d, "events").groupBy((e % m.PRODUCTS).alias("product_id"), dimension.alias("dimension_slug"), "event_type").agg(F.count("*").alias("vote_count"))
    option = F.coalesce(F.when(F.col("dimension_slug") == "season", season).when(F.col("dimension_slug") == "time_of_day", hour), kind)
    votes = counted.select("product_id", "dimension_slug", F.concat(F.lit("The "), "dimension_slug").alias("dimension_name"), option.alias("option_slug"), F.upper(kind).alias("option_label"), F.length(kind).alias("sort_order"), "vote_count")
    s, order, line = m.sizes(spark, d), F.col("order_id"), F.col("line")
    url = F.when(order % 4 == 1, "https://www.brand-11.test/").when(order % 4 == 2, F.concat(F.lit("https://www.shop"), (order % 3).cast("string"), F.lit(".test/p/"), k.cast("string"))).when(order % 4 == 3, "no url")
    sizes = s.select(
        "product_id", (order * 10 + line).alias("size_id"), line.alias("position"), (F.col("flag") == "R").cast("int").alias("is_primary"), F.when(order % 5 > 0, F.col("grams")).alias("size_grams"), F.when(order % 3 == 0, F.col("grams") / 2).alias("size_value"), F.lit("oz").alias("size_unit"),
        F.when(line != 2, F.col("grams")).alias("burn_time_hours"), F.when(order % 7 > 0, F.col("price")).alias("price_amount"), F.when(line % 3 == 1, "EUR").when(line % 3 == 2, "USD").alias("price_currency"), url.alias("source_url"),
    )
    reminds = s.select("product_id", (order * 10 + line).alias("remind_id"), F.when(line != 3, F.col("grams")).alias("thumbs_up"), F.when(line != 1, F.concat(F.lit("Candle "), order.cast("string"))).alias("external_product_name"), F.lit(None).cast("string").alias("external_brand_name"), F.lit(None).cast("string").alias("external_source_url"))
    r = F.col("review_id")
    reviews = m.reviews(spark, d).select("product_id", "review_id", "status", F.when(r % 6 > 0, F.col("user_id") % 5 + 1).alias("rating"), F.when(r % 4 > 0, F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("author_name"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("Order "), r.cast("string")).alias("body"), F.when(r % 3 > 0, F.col("created")).alias("published_at"), F.col("created").alias("created_at"))
    profiles = parts.select("product_id", F.concat(F.lit("In a word: "), "category_slug").alias("summary"))
    categories = parts.select(F.col("category_slug").alias("category_id")).distinct()
    return dict(products=products, categories=categories, brands=brands, profiles=profiles, notes=notes, accords=accords, votes=votes, ratings=m.ratings(spark, d).filter(k % 2 == 0), reminds=reminds, reviews=reviews, sizes=sizes)


def _line(array, *fields, by=" ", end=","):
    return F.array_join(F.transform(array, lambda x: F.concat_ws(by, *[x[f].cast("string") for f in fields])), end)


@query(_ROWS)
def product_view(spark, d):
    """The whole document of every product; nested parts are written out as text, so that both sides compare."""
    full = view(**_tables(spark, d))
    pyramid = F.array_join(F.transform("pyramid", lambda g: F.concat(g["stage"], F.lit(":"), _line(g["notes"], "name", "color"))), "|")
    votes = F.array_join(F.transform("votes", lambda v: F.concat(v["dimension"], F.lit(" "), v["total"].cast("string"), F.lit(":"), _line(v["options"], "label", "pct"))), "|")
    told = F.filter("specs", lambda x: x["value"].isNotNull())
    return full.select(
        "product_id", "name", "brand", "brand_slug", "brand_country", "scent_type", "year", "from_price", "summary", F.round("rating.avg", 6).alias("rating_avg"), F.col("rating.count").alias("rating_count"), pyramid.alias("pyramid"),
        _line("accords", "name", "color", "pct").alias("accords"), _line("accord_chips", "name", "color").alias("accord_chips"), votes.alias("votes"), *[_line(c, "name", "option_slug", "count", "pct").alias(c) for c in ("seasons", "day_night")],
        _line(told, "label", "value").alias("specs"), _line("stockists", "name", "kind", "price", "url").alias("stockists"), _line("similar", "name", "tone").alias("similar"), _line("reviews", "author", "rating", "body").alias("reviews"), _line("rating_dist", "stars", "pct").alias("rating_dist"),
    )
