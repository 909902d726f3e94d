"""Queries of imports: records checked against the product schema, uploaded files, records put together from paths, natural order with accents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import prose
from ..operators import catalogue, ld, schema, store
from ..operators.work import spread, work_place
from . import model as m
from .queries import query


def _documents(spark, d):
    """Parts as JSON products with faults, by remainders of their keys."""
    p = spread(m.table(spark, d, "part"), "p_partkey")
    k, t = F.col("p_partkey"), lambda x: F.lit(x)
    name = F.when(k % 11 == 0, "").when(k % 7 == 0, '"name": "", ').otherwise(F.concat(t('"name": "'), F.col("p_name"), t('", ')))
    year = F.when(k % 3 == 0, "null").when(k % 5 == 0, "1.5").otherwise(F.col("p_size").cast("string"))
    sizes = F.concat(t('[{"size_grams": '), F.col("p_size").cast("string"), t(', "price_amount": '), F.when(k % 4 == 0, '"x"').otherwise("100"), t('}, {"is_primary": '), F.when(k % 6 == 0, '"yes"').otherwise("true"), t(', "sku": null}]'))
    image = F.concat(t('[{"position": '), F.when(k % 8 == 0, "-1").otherwise("0"), t(', "is_primary": true'), F.when(k % 9 == 0, "").otherwise(', "source_url": "http://a.org/x"'), t("}]"))
    note = F.concat(t('[{"note_slug": "a", "name": "A", "pyramid_stage": "'), F.when(k % 10 == 0, "heart").otherwise("top"), t('", "color": "'), F.when(k % 14 == 0, "#12345g").otherwise("#A0b1C2"), t('"}]'))
    doc = F.concat(t("{"), name, t('"category_slug": '), F.when(k % 13 == 0, "5").otherwise('"candles"'), t(', "brand_slug": "'), F.lower(F.replace("p_brand", t("#"), t("-"))), t('", "release_year": '), year, t(', "sizes": '), F.when(k % 17 == 0, "{}").otherwise(sizes), t(', "images": '), image, t(', "notes": '), note, t(', "_timing": {"s": 1}, "extra": {"x": [1]}}'))
    return p.select(k.cast("long").alias("product_id"), "p_size", F.when(k % 19 == 0, "{not json").otherwise(doc).alias("text"))


@query("""SELECT product_id, place - 1 AS place, e.path AS path, e.message AS message FROM (SELECT product_id, unnest(found) AS e, generate_subscripts(found, 1) AS place FROM (SELECT p_partkey::BIGINT AS product_id, CASE WHEN k % 19 = 0 THEN [{'path': '', 'message': 'not JSON'}] ELSE list_filter([
CASE WHEN k % 13 = 0 THEN {'path': 'category_slug', 'message': 'expected text'} END, CASE WHEN k % 11 = 0 THEN {'path': 'name', 'message': 'required'} WHEN k % 7 = 0 THEN {'path': 'name', 'message': 'shorter than 1'} END,
CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN {'path': 'release_year', 'message': 'not whole'} END, CASE WHEN k % 17 = 0 THEN {'path': 'sizes', 'message': 'expected a list'} WHEN k % 4 = 0 THEN {'path': 'sizes.0.price_amount', 'message': 'expected a number'} END,
CASE WHEN k % 17 <> 0 AND k % 6 = 0 THEN {'path': 'sizes.1.is_primary', 'message': 'expected true or false'} END, CASE WHEN k % 8 = 0 THEN {'path': 'images.0.position', 'message': 'below 0'} WHEN k % 9 = 0 THEN {'path': 'images.0', 'message': 'Image must include source_url or data_base64'} END,
CASE WHEN k % 10 = 0 THEN {'path': 'notes.0.pyramid_stage', 'message': 'not one of top, middle, base, general, unknown'} END, CASE WHEN k % 14 = 0 THEN {'path': 'notes.0.color', 'message': 'not of the pattern'} END], lambda x: x IS NOT NULL) END AS found FROM (SELECT *, p_partkey AS k FROM part)))""")
def import_errors(spark, d):
    found = _documents(spark, d).select("product_id", schema.errors(F.try_parse_json("text")).alias("found"))
    return found.select("product_id", F.posexplode("found").alias("place", "e")).select("product_id", F.col("place").cast("long"), "e.path", "e.message")


@query("""SELECT p_size::BIGINT AS file, CASE WHEN bool_or(p_partkey % 19 = 0) THEN NULL ELSE arg_min(CASE WHEN ok THEN brand END, CASE WHEN ok THEN p_partkey END) END AS brand_slug, CASE WHEN bool_or(p_partkey % 19 = 0) THEN 0 ELSE count(*) FILTER (ok) END AS products,
CASE WHEN bool_or(p_partkey % 19 = 0) THEN 0 ELSE count(*) FILTER (ok) END AS images, CASE WHEN bool_or(p_partkey % 19 = 0) THEN 0 ELSE count(*) FILTER (NOT ok) END AS invalid, CASE WHEN bool_or(p_partkey % 19 = 0) THEN 'Invalid JSON file' WHEN NOT bool_or(ok) THEN 'Could not detect brand_slug from import file' END AS error
FROM (SELECT *, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 13 <> 0 AS ok, lower(replace(p_brand, '#', '-')) AS brand FROM part WHERE p_size % 3 <> 0 OR p_partkey % 19 <> 0) GROUP BY 1""")
def import_uploads(spark, d):
    rows = _documents(spark, d).filter("p_size % 3 <> 0 or product_id % 19 <> 0")
    lists = rows.groupBy(F.col("p_size").cast("long").alias("file")).agg(F.array_sort(F.collect_list(F.struct("product_id", "text"))).alias("rows"))
    files = lists.select("file", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["text"]), ", "), F.lit("]")).alias("text"))
    return schema.import_files(files)[2].select("file", "brand_slug", "products", "images", "invalid", "error")


@query("""SELECT l_orderkey AS key, '{' || CASE WHEN n >= 2 THEN '"a":' || CASE WHEN n = 2 THEN q2::VARCHAR WHEN n = 3 THEN '{"b":' || q3 || '}' WHEN n = 4 THEN '{"b":' || q3 || ',"c":{"d":' || q4 || '}}' WHEN n = 5 THEN '{"b":' || q3 || ',"c":' || q5 || '}' ELSE '{"b":' || q3 || ',"c":{"e":' || q6 || '}}' END || ',' ELSE '' END || '"name":' || q1 || CASE WHEN n >= 7 THEN ',"x":{"y":' || q7 || '}' ELSE '' END || '}' AS record
FROM (SELECT l_orderkey, count(*) AS n, max(q) FILTER (i = 1) AS q1, max(q) FILTER (i = 2) AS q2, max(q) FILTER (i = 3) AS q3, max(q) FILTER (i = 4) AS q4, max(q) FILTER (i = 5) AS q5, max(q) FILTER (i = 6) AS q6, max(q) FILTER (i = 7) AS q7
FROM (SELECT l_orderkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem) GROUP BY 1)""")
def assembled_records(spark, d):
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    named = ["name", "a", "a.b", "a.c.d", "a.c", "a.c.e", "x[].y"]
    ways = F.create_map(*[F.lit(x) for i, way in enumerate(named, 1) for x in (i, way)])
    rows = m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), line.alias("place"), F.to_json(F.struct(F.col("l_quantity").cast("long").alias("q"))).alias("q"))
    rows = rows.select("key", "place", F.try_element_at(ways, "place").alias("path"), F.try_variant_get(F.parse_json("q"), "$.q", "variant").alias("value"))
    return schema.assembled(rows, max(way.count(".") + 1 for way in named)).select("key", F.to_json("record").alias("record"))


@query("""SELECT k AS product_id, row_number() OVER (ORDER BY lower(strip_accents(regexp_extract(name, '^(\\D*)', 1))), k % 1000, k)::INT AS place FROM (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Éclair ' WHEN 1 THEN 'eclair ' WHEN 2 THEN 'Zebra ' ELSE 'ünder ' END || p_partkey % 1000 AS name FROM part)""")
def natural_accents(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 4 == 0, "Éclair ").when(k % 4 == 1, "eclair ").when(k % 4 == 2, "Zebra ").otherwise("ünder "), (k % 1000).cast("string"))
    return catalogue.ranked(m.table(spark, d, "part").select(k.alias("product_id"), name.alias("name")), "name", "product_id").select("product_id", "place")


@query("""SELECT product_id, place, value, grams, price, currency, sku, place = 0 AS is_primary FROM (SELECT product_id, (row_number() OVER (PARTITION BY product_id ORDER BY i) - 1)::INT AS place, * EXCLUDE (product_id) FROM (
SELECT product_id, min(i) AS i, value, any_value(grams) AS grams, arg_min(price, i) AS price, arg_min(currency, i) AS currency, sku FROM (
SELECT k AS product_id, 0 AS i, s::DOUBLE AS value, s AS grams, CASE WHEN k % 3 = 2 THEN 1250 ELSE s * 100 END AS price, CASE WHEN k % 3 = 2 THEN 'GBP' ELSE 'EUR' END AS currency, 'p' || k AS sku FROM p
UNION ALL SELECT k, 1, s, s, s * 100, 'EUR', 'p' || k FROM p WHERE k % 3 = 1 UNION ALL SELECT k, 2, 2, 57, 150, 'USD', 'o' || k FROM p WHERE k % 3 = 1
UNION ALL SELECT k, 3, 1, 1000, 999, CASE WHEN k % 3 = 2 THEN 'GBP' ELSE 'EUR' END, 'v1' FROM p UNION ALL SELECT k, 4, s, s, NULL, CASE WHEN k % 3 = 2 THEN 'GBP' ELSE 'EUR' END, 'p' || k FROM p WHERE k % 5 = 0
) GROUP BY product_id, value, sku, (CASE WHEN i = 2 THEN 'oz' WHEN i = 3 THEN 'kg' ELSE 'g' END)))""".replace("FROM p", "FROM (SELECT p_partkey AS k, p_size::INT AS s FROM part) AS p"))
def ld_sizes(spark, d):
    p = spread(m.table(spark, d, "part"), "p_partkey")
    k, key, size = F.col("p_partkey"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    t = lambda x: F.lit(x)
    one = F.concat(t('{"price": "'), size, t('.00", "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}'))
    offers = F.when(k % 3 == 0, one).when(k % 3 == 1, F.concat(t("["), one, t(', 5, {"size": "2 oz", "price": 1.5, "priceCurrency": "USD", "sku": "o'), key, t('"}]'))).otherwise('{"price": 1250, "priceCurrency": "GBP"}')
    variants = F.concat(t('[{"size": "1kg", "sku": "v1", "offers": {"price": "9.99"}}, {}'), F.when(k % 5 == 0, F.concat(t(', {"size": "'), size, t(' g", "sku": "p'), key, t('"}'))).otherwise(""), t("]"))
    doc = F.concat(t('{"size": "'), size, t(' g", "sku": "p'), key, t('", "offers": '), offers, t(', "hasVariant": '), variants, t("}"))
    found = p.select(k.alias("product_id"), F.explode(ld.sizes(F.parse_json(doc), F.lit("https://a.org"))).alias("s"))
    return found.select("product_id", "s.place", "s.value", "s.grams", "s.price", "s.currency", "s.sku", "s.is_primary")


@query("""SELECT k AS product_id, CASE k % 5 WHEN 0 THEN list_transform(list_filter(w, lambda x: length(x) > 2), lambda x: x || '=unknown') WHEN 1 THEN list_concat([w[1] || '=top', 'x=top'], [w[2] || '=middle'], [w[1] || '=base', w[2] || '=base'])
WHEN 2 THEN list_transform(list_filter([w[1], 'fine moss'], lambda x: length(x) > 2), lambda x: x || '=unknown') ELSE []::VARCHAR[] END AS notes,
CASE k % 5 WHEN 0 THEN []::VARCHAR[] WHEN 3 THEN ['Chypre ' || w[1], 'woody', 'leather', 'warm'] WHEN 4 THEN ['amber', 'sweet'] WHEN 2 THEN ['green'] ELSE []::VARCHAR[] END AS accords FROM (SELECT p_partkey AS k, string_split(p_name, ' ') AS w FROM part)""")
def prose_notes(spark, d):
    k, w = F.col("p_partkey"), F.split("p_name", " ")
    t = lambda x: F.lit(x)
    forms = [
        F.concat(t("Warm and amber.\nTasting  Notes : "), w[0], t(", "), w[1], t("\nNotes: none")), F.concat(t("Olfactory notes: top: "), w[0], t(", x; HEART: "), w[1], t(". base : "), w[0], t(" and "), w[1]),
        F.concat(t("Green.\nFragrance notes\n1. "), w[0], t(", 2.x, 3. fine moss\nMade by hand, slowly")), F.concat(t("A WARM woody leather. Olfactive family: Chypre "), w[0], t(".")), F.concat(t("Amber, olfactive family: AMBER\nvery sweet")),
    ]
    x = F.coalesce(*[F.when(k % 5 == i, f) for i, f in enumerate(forms)])
    found = spread(m.table(spark, d, "part"), "p_partkey").select(k.alias("product_id"), prose.notes_and_accords(x).alias("f"))
    return found.select("product_id", F.transform("f.notes", lambda n: F.concat(n["name"], F.lit("="), n["stage"])).alias("notes"), "f.accords")


def _incoming(rows, version):
    """Parts as rows to import: later versions give some of the fields."""
    k = F.col("p_partkey")
    gone = lambda c, n: F.when((k % n != 0) | (F.lit(version) == 1), c)
    sizes = F.transform(F.sequence(F.lit(1), (k % 3).cast("int") + 1), lambda i: F.struct((i * 100 + version).cast("int").alias("grams"), (i * k + version).cast("long").alias("price")))
    name = F.when(k % 23 != 0, F.concat("p_name", F.lit(" "), k.cast("string")))
    return rows.select(k.alias("place"), F.concat(F.lit("p-"), k.cast("string")).alias("slug"), name.alias("name"), gone(F.concat("p_brand", F.lit(f" v{version}")), 4).alias("brand"), gone(F.lit(f"text {version}"), 5).alias("description"), gone(F.split("p_name", " "), 11).alias("notes"), gone(sizes, 7).alias("sizes"))


@query("""SELECT 'p-' || k AS slug, p_name || ' ' || k AS name, p_brand || ' v' || vb AS brand, p_name || ' ' || k || ' ' || p_brand || ' v' || vb || ' ' || p_name || ' text ' || vd AS text, (k % 3 + 1)::BIGINT AS n_sizes, (k + vs)::BIGINT AS price FROM (
SELECT *, CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 2 ELSE 1 END AS vb, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 2 ELSE 1 END AS vd, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 2 ELSE 1 END AS vs FROM (SELECT *, p_partkey AS k FROM part))
WHERE k % 23 <> 0 AND (k % 3 <> 0 OR k % 2 = 0) AND NOT (k % 3 = 0 AND (k % 4 = 0 OR k % 5 = 0 OR k % 11 = 0 OR k % 7 = 0))""")
def imported_products(spark, d):
    """Two imports: parts that three doesn't divide, then the even ones with some fields left out (those new then and incomplete are not shown)."""
    parts, kept_at = m.table(spark, d, "part"), store.Store(work_place(spark), 16)
    kept_at.load(_incoming(parts.filter("p_partkey % 3 <> 0"), 1))
    kept_at.load(_incoming(parts.filter("p_partkey % 2 = 0"), 2))
    sizes = kept_at.table(spark, "sizes").groupBy("slug").agg(F.count("*").alias("n_sizes"), F.min(F.when(F.col("is_primary"), F.col("price"))).alias("price"))
    found = kept_at.table(spark, "products").join(kept_at.table(spark, "documents").select("slug", "text"), "slug").join(sizes, "slug")
    k = F.substring("slug", 3, 20).cast("long")
    return found.filter(~((k % 3 == 0) & ((k % 4 == 0) | (k % 5 == 0) | (k % 11 == 0) | (k % 7 == 0)))).select("slug", "name", "brand", "text", "n_sizes", "price")
