"""Facets, documents, votes, reviews, search and writes of the catalogue."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers


@dataclass
class Filters:
    """Facet choices: notes and accords are any-of, votes are all-of."""

    category: str | None = None
    brand: str | None = None
    min_rating: float | None = None
    notes: list[str] = field(default_factory=list)
    accords: list[str] = field(default_factory=list)
    votes: list[str] = field(default_factory=list)
    sort: str = "name"
    limit: int = 20
    offset: int = 0


def filters_of(params: dict[str, str]) -> Filters:
    """Filters from the parameters of a request: lists by comma, blanks dropped, numbers read; what isn't named keeps its default."""

    def names(key):
        return [x.strip() for x in params.get(key, "").split(",") if x.strip()]

    rating = params.get("min_rating")
    return Filters(
        params.get("category") or None, params.get("brand") or None, float(rating) if rating else None, names("notes"), names("accords"), names("vote_options"),
        params.get("sort") or "name", int(params.get("limit") or 20), int(params.get("offset") or 0),
    )


def facet(products: DataFrame, chosen: Filters, ratings: DataFrame, notes: DataFrame, votes: DataFrame, accords: DataFrame | None = None) -> DataFrame:
    """The chosen products, unsorted; semi joins keep one row each, and tables that no filter needs stay out of the plan."""
    if chosen.category:
        products = products.filter(F.col("category_slug") == chosen.category)
    if chosen.brand:
        products = products.filter(F.col("brand_slug") == chosen.brand)
    if chosen.notes:
        products = products.join(notes.filter(F.col("note").isin(chosen.notes)), "product_id", "left_semi")
    if chosen.accords:
        products = products.join(accords.filter(F.col("accord").isin(chosen.accords)), "product_id", "left_semi")
    for option in chosen.votes:
        products = products.join(votes.filter((F.col("option") == option) & (F.col("votes") > 0)), "product_id", "left_semi")
    if chosen.min_rating is not None:
        return products.join(ratings.filter(F.col("rating_avg") >= chosen.min_rating), "product_id")
    return products.join(ratings, "product_id", "left") if chosen.sort == "rating" else products


def page(found: DataFrame, chosen: Filters) -> DataFrame:
    order = [F.col("rating_avg").desc_nulls_last()] if chosen.sort == "rating" else [F.col("name").asc_nulls_first()]
    return found.orderBy(*order, "product_id").offset(chosen.offset).limit(chosen.limit)


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Upsert's outcome: the last row of each key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")


def vote_counts(votes: DataFrame) -> DataFrame:
    return votes.groupBy("product_id", "option").agg(F.count("*").alias("votes"))


def shares(counts: DataFrame, group: str, value: str) -> DataFrame:
    """counts with the percentage each has of its group."""
    return counts.withColumn("pct", numbers.percent(F.col(value), F.sum(value).over(Window.partitionBy(group))))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """stars 5 to 1 with count and percentage, zeroes too; one pass, no join."""
    star = numbers.round_half_up(F.col("rating"))
    one = ratings.agg(F.count("*").alias("total"), *[F.count_if(star == s).alias(f"n{s}") for s in range(1, 6)])
    rows = one.select("total", F.explode(F.array(*[F.struct(F.lit(s).alias("stars"), F.col(f"n{s}").alias("n")) for s in range(5, 0, -1)])).alias("r"))
    return rows.select("r.stars", "r.n", numbers.percent(F.col("r.n"), F.col("total")).alias("pct"))


def buckets(counts: DataFrame, option: str, value: str, named: dict[str, list[str]]) -> DataFrame:
    """Sums of options in fixed buckets, zeroes too, with shares of all that fall in one."""
    sums = counts.agg(*[F.coalesce(F.sum(F.when(F.col(option).isin(v), F.col(value))), F.lit(0)).alias(k) for k, v in named.items()])
    total = sum((F.col(k) for k in named), F.lit(0))
    rows = sums.select(total.alias("total"), F.explode(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col(k).alias("n")) for k in named])).alias("r"))
    return rows.select("r.bucket", "r.n", numbers.percent(F.col("r.n"), F.col("total")).alias("pct"))


def documents(products: DataFrame, **children: DataFrame) -> DataFrame:
    """products with an array of structs for each child table, ordered by the child's columns after product_id.

    Each child is grouped before its join, so children never multiply.
    """
    for name, rows in children.items():
        rest = [c for c in rows.columns if c != "product_id"]
        nested = rows.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
        products = products.join(nested, "product_id", "left").withColumn(name, F.coalesce(name, F.array()))
    return products


def related(products: DataFrame, fetch: int = 8, take: int = 5) -> DataFrame:
    """For each product, the first `take` others among the first `fetch` of its brand by name.

    Only the first rows of a brand meet the brand's products, so pairs grow by `fetch` at most.
    """
    order = Window.partitionBy("brand_slug").orderBy("name", "product_id")
    first = products.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= fetch).select("brand_slug", F.col("product_id").alias("related_id"), "_n")
    met = products.select("product_id", "brand_slug").join(first, "brand_slug").filter("product_id <> related_id")
    rank = Window.partitionBy("product_id").orderBy("_n")
    return met.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= take).select("product_id", "related_id", "rank")


def letters(rows: DataFrame, name: str) -> DataFrame:
    first = F.upper(F.left(F.col(name), F.lit(1)))
    return rows.groupBy(F.when(first.rlike("[A-Z]"), first).otherwise("#").alias("letter")).agg(F.count("*").alias("n"))


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Inverted index: key, token, tf."""
    every = rows.select(F.col(key), F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("token")).filter("token <> ''")
    return every.groupBy(key, "token").agg(F.count("*").alias("tf"))


def search(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys that have all words (implicit AND); one aggregation over the words' postings."""
    words = sorted({w.lower() for w in words})
    hit = index.filter(F.col("token").isin(words)).groupBy(key).agg(F.count("*").alias("n"), F.sum("tf").alias("hits"))
    return hit.filter(F.col("n") == len(words)).select(key, "hits")


def merge(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace those with their key (the last of each) or are added; incoming rows without a key go, existing ones stay."""
    new = latest(incoming.filter(F.col(key).isNotNull()), [key], [F.col("seq").desc()])
    kept = existing.join(new.select(key), key, "left_anti")
    return kept.unionByName(new)


def duplicates(rows: DataFrame, key: str, item: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(item).alias("first_item"), F.max(item).alias("last_item")).filter("n > 1")


def dedupe_spellings(rows: DataFrame, name: str, order: str, all_caps) -> DataFrame:
    """One spelling for each name that differs by case alone: the first that isn't all capitals, else the first."""
    best = F.min_by(F.col(name), F.struct(all_caps(F.col(name)), F.col(order)))
    return rows.filter(F.col(name).isNotNull()).groupBy(F.lower(name).alias("key")).agg(best.alias("name"), F.count("*").alias("n"))


def dedupe_sizes(sizes: DataFrame) -> DataFrame:
    """One row for each product and weight: the first with a price, else the first; its nulls filled from the others in order."""
    rank = F.struct(F.col("price").isNull(), F.col("position"))

    def fill(name):
        return F.min_by(name, F.when(F.col(name).isNotNull(), rank)).alias(name)

    one = sizes.filter("grams is not null").groupBy("product_id", "grams").agg(F.min_by("position", rank).alias("position"), fill("price"), fill("sku"), F.bool_or("is_primary").alias("is_primary"))
    return one.unionByName(sizes.filter("grams is null").select(one.columns))


def import_status(incoming: DataFrame, existing: DataFrame, key: str, changed) -> DataFrame:
    """incoming with status failed, created, updated or skipped."""
    known = existing.select(key, F.lit(True).alias("_known"), F.col("hash").alias("_hash"))
    met = incoming.join(known, key, "left")
    status = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "failed").when(F.col("_known").isNull(), "created").when(changed(F.col("hash"), F.col("_hash")), "updated").otherwise("skipped")
    return met.withColumn("status", status).drop("_known", "_hash")


def _same(names, other):
    """Null-safe equality of columns with those that have `other` before their names."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"{other}{n}"))
    return cond


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with _n, 1, 2, ... within keys in order (nulls last), and the pieces it is counted by: _piece, _from (rows of the keys before it) and _size.

    A hash sample of 1,024 rows gives 64 ranges of the order; pieces of a key are counted apart and get
    offsets, at most 64 a key, so no task holds all rows of a frequent key.
    """
    at = rows.withColumn("_at", F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("value"), F.xxhash64(*rows.columns).alias("tie")))
    sample = at.select("_at").orderBy("_at.tie", "_at").limit(1024).agg(F.sort_array(F.collect_list("_at")).alias("s"))
    bounds = sample.select(F.filter("s", lambda x, i: i % 16 == 15).alias("_bounds"))
    at = at.crossJoin(F.broadcast(bounds)).withColumn("_piece", F.size(F.filter("_bounds", lambda x: x < F.col("_at")))).drop("_bounds")
    pieces = at.groupBy(*keys, "_piece").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_piece")) - F.col("_size")
    pieces = pieces.withColumn("_from", before).withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_piece"]})
    at = at.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy("_at")))
    met = at.join(pieces, _same([*keys, "_piece"], "_of_")).withColumn("_n", F.col("_n") + F.col("_from"))
    return met.drop("_at", *[f"_of_{k}" for k in [*keys, "_piece"]])


def unique_slugs(rows: DataFrame, site: str = "site", order: str = "position") -> DataFrame:
    """rows with slug made unique within a site, -2, -3, ... in order; a suffix already in use is passed over.

    Slugs that occur once never change. The n-th row of a repeated slug gets its n-th free suffix: n + 1 and one more
    for each suffix in use that has fewer than n free ones below it, counted within pieces.
    """
    keys = [site, "slug"]
    count = rows.filter("slug != ''").groupBy(*keys).agg(F.count("*").alias("_count")).filter("_count > 1").select(*[F.col(k).alias(f"_of_{k}") for k in keys])
    again = rows.join(count, _same(keys, "_of_"), "left_semi")
    once = rows.join(count, _same(keys, "_of_"), "left_anti")

    row = numbered(again, keys, order)
    piece = row.select(*keys, "_piece", "_from", "_size").distinct()
    suffix = F.regexp_extract("slug", r"-([1-9]\d{0,17})$", 1)
    taken = once.withColumn("_k", suffix).filter("_k != ''").select(site, F.expr("left(slug, length(slug) - length(_k) - 1)").alias("slug"), F.col("_k").cast("long").alias("_k"))
    taken = taken.filter("_k > 1").join(count, _same(keys, "_of_"), "left_semi")
    taken = numbered(taken, keys, "_k").select(*[F.col(k).alias(f"_of_{k}") for k in keys], (F.col("_k") - 1 - F.col("_n")).alias("_free"))
    met = piece.join(taken, _same(keys, "_of_"))
    below = met.groupBy(*keys, "_piece").agg(F.count_if(F.col("_free") < F.col("_from")).alias("_below")).withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_piece"]})
    inside = met.filter("_free >= _from and _free < _from + _size").select(*keys, "_piece", F.col("_free").alias("_place"), F.lit(0).alias("_kind"))

    both = row.drop("_from", "_size").withColumn("_place", F.col("_n") - 1).withColumn("_kind", F.lit(1)).unionByName(inside, allowMissingColumns=True)
    passed = F.count_if(F.col("_kind") == 0).over(Window.partitionBy(*keys, "_piece").orderBy("_place", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    given = both.withColumn("_passed", passed).filter("_kind = 1").join(below, _same([*keys, "_piece"], "_of_"), "left")
    number = F.col("_n") + 1 + F.col("_passed") + F.coalesce("_below", F.lit(0))
    slug = F.concat("slug", F.lit("-"), number.cast("string"))
    given = given.select(*[(slug if c == "slug" else F.col(c)).alias(c) for c in rows.columns])
    return once.unionByName(given)


def community(catalog: DataFrame, counts: DataFrame, order: list[str]) -> DataFrame:
    """All options of the named dimensions in their order, with counts (zeroes too), totals and shares.

    catalog: dimension, option, sort_order. counts: dimension, option, n; other dimensions are left out.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col("dimension"))
    rows = catalog.withColumn("place", place.cast("int")).filter("place > 0").join(counts, ["dimension", "option"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("dimension"))
    return rows.select("place", "dimension", "sort_order", "option", "n", total.alias("total"), numbers.percent(F.col("n"), total).alias("pct"))


def _plain_letters() -> tuple[str, str]:
    """Latin letters with accents, and the letters beneath them."""
    marked = [c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def natural_key(name):
    """A sort key that ignores case and accents and reads digits as numbers of any length: their length comes before them."""
    plain = F.lower(F.translate(F.regexp_replace(name, r"\p{M}+", ""), *_plain_letters()))
    parts = F.regexp_extract_all(plain, F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(p):
        digits = F.ltrim(p, F.lit("0"))
        return F.concat(F.lpad(F.char_length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), number(p)).otherwise(p)), "")


def ranked(rows: DataFrame, name: str, tie: str) -> DataFrame:
    """rows with place, 1, 2, ... in the natural order of `name` (then `tie`); ranges are counted apart and get offsets."""
    keyed = rows.select(F.struct("*").alias("row"), F.struct(natural_key(F.col(name)).alias("key"), F.col(tie).alias("tie")).alias("by"))
    return numbered(keyed, [], "by").select("row.*", F.col("_n").cast("int").alias("place"))
