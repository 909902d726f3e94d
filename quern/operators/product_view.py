"""One document a product: the whole page of it, built from its parent, its brand and eight child tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display, numbers
from .views import accord_bars, ordered_children

#: Names of note stages, in display order.
STAGES = {"Top": ("top",), "Heart": ("middle", "heart"), "Base": ("base",)}
REST = "Other"
#: Seasons in display order, and the times of day that count as day and night.
SEASONS = {"spring": "Spring", "summer": "Summer", "autumn": "Autumn", "winter": "Winter"}
HALVES = {"day": ("Day", ("morning", "day")), "night": ("Night", ("evening", "night"))}
#: Backgrounds of similar products, in turn.
TONES = ("olive", "espresso", "oxblood", "stone", "taupe")
CHIPS, SIMILAR, REVIEWS = 5, 4, 6


def first_rows(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each product with their place, _n. Each task keeps k of a product before the shuffle, so a product with very many rows stays small."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("product_id").orderBy(*order))).filter(F.col("_n") <= k)


def note_groups(notes: Column) -> Column:
    """Groups (stage, notes) in display order from an array of notes (stage, name, color); a stage that isn't known is Other, empty groups go."""
    named = F.transform(notes, lambda n: F.struct(_stage(n["stage"]).alias("stage"), n["name"].alias("name"), n["color"].alias("color")))

    def group(stage):
        own = F.filter(named, lambda n: n["stage"] == stage)
        return F.struct(F.lit(stage).alias("stage"), F.transform(own, lambda n: F.struct(n["name"].alias("name"), n["color"].alias("color"))).alias("notes"))

    return F.filter(F.array(*map(group, [*STAGES, REST])), lambda g: F.size(g["notes"]) > 0)


def _stage(stage: Column) -> Column:
    found = F.lit(REST)
    for name, known in STAGES.items():
        found = F.when(F.lower(stage).isin(*known), name).otherwise(found)
    return found


def vote_parts(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(product_id, votes: dimensions by slug with their options' shares), (product_id, seasons, day_night: fixed entries, zeroes too).

    Shares of seasons and halves of the day are of all votes of that dimension, those for other options included.
    """
    count = F.coalesce("vote_count", F.lit(0))
    apart = F.col("dimension_slug").isin("season", "time_of_day")
    options = F.array_sort(F.collect_list(F.struct("sort_order", "option_slug", "option_label", count.alias("n"))))
    rest = votes.filter(~apart).groupBy("product_id", "dimension_slug").agg(F.min("dimension_name").alias("dimension"), F.sum(count).alias("total"), options.alias("options"))
    shared = F.transform("options", lambda o: F.struct(o["option_label"].alias("label"), numbers.percent(o["n"], F.col("total")).alias("pct")))
    dimensions = ordered_children(rest.withColumn("options", shared), "product_id", [F.col("dimension_slug")], ["dimension", "total", "options"], "votes")

    def total(dimension, *slugs):
        held = F.col("dimension_slug") == dimension
        return F.sum(F.when(held & F.col("option_slug").isin(*slugs) if slugs else held, count).otherwise(0))

    sums = [total("season").alias("_s"), total("time_of_day").alias("_t"), *[total("season", s).alias(f"_s_{s}") for s in SEASONS], *[total("time_of_day", *slugs).alias(f"_t_{half}") for half, (_, slugs) in HALVES.items()]]
    return dimensions, votes.filter(apart).groupBy("product_id").agg(*sums)


def _bars(names: dict[str, str], place: str) -> Column:
    """Entries (name, option_slug, count, pct) from the sums that vote_parts makes, null sums as zero."""
    all_of = F.coalesce(place, F.lit(0))
    n = {slug: F.coalesce(f"{place}_{slug}", F.lit(0)) for slug in names}
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(slug).alias("option_slug"), n[slug].alias("count"), numbers.percent(n[slug], all_of).alias("pct")) for slug, name in names.items()])


def size_parts(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(product_id, primary_size, cheapest), (product_id, shops: the first size of each source url, in the sizes' order).

    The sizes' order is position, primary ones first, grams, size_id; nulls come first. The primary size is the first
    flagged one, else the first; the cheapest is the first of the least price.
    """
    primary = F.coalesce(F.col("is_primary").cast("boolean"), F.lit(False))
    order = F.struct("position", (~primary).alias("later"), "size_grams", "size_id")
    item = F.struct("size_value", "size_unit", "size_grams", "burn_time_hours", "price_amount", "price_currency")
    chosen = sizes.groupBy("product_id").agg(
        F.min_by(item, F.struct((~primary).alias("later"), order.alias("order"))).alias("primary_size"),
        F.min_by(item, F.when(F.col("price_amount").isNotNull(), F.struct("price_amount", order.alias("order")))).alias("cheapest"),
    )
    first = sizes.filter("source_url <> ''").groupBy("product_id", "source_url").agg(F.min(F.struct(order.alias("order"), "price_amount", "price_currency")).alias("first"))
    rows = first.select("product_id", "source_url", "first.*")
    return chosen, ordered_children(rows, "product_id", [F.col("order")], ["source_url", "price_amount", "price_currency"], "shops")


def review_parts(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(product_id, reviews: the first six approved ones, newest publication first), (product_id, mean, n, stars 5 to 1 of those with a rating)."""
    approved = reviews.filter("status = 'approved'")
    order = [F.col("published_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("review_id")]
    shown = first_rows(approved, order, REVIEWS)
    shown = ordered_children(shown, "product_id", [F.col("_n")], [F.coalesce("author_name", F.lit("Anonymous")).alias("author"), "rating", "title", "body"], "reviews")
    rated, star = approved.filter("rating is not null"), numbers.round_half_up(F.col("rating"))
    return shown, rated.groupBy("product_id").agg(F.avg("rating").alias("_avg"), F.count("*").alias("_n"), *[F.count_if(star == s).alias(f"_star_{s}") for s in range(5, 0, -1)])


def product_view(products: DataFrame, categories: DataFrame, brands: DataFrame, profiles: DataFrame, notes: DataFrame, accords: DataFrame, votes: DataFrame, ratings: DataFrame, reminds: DataFrame, reviews: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a product that has a category: scalars, and structs or arrays for rating, pyramid, accords, accord_chips, votes, seasons, day_night, specs, stockists, similar, reviews, rating_dist.

    Every child is reduced by product before its join: children never multiply, and of reviews and similar products
    no task holds more of a product than is shown. A rating from approved reviews comes before the stored one; rating_dist is null without such.
    Products keep their row without a brand or children (empty arrays); keys are unique in products, categories, brands, profiles and ratings.
    """
    color = display.entity_color(F.col("color"), F.col("note_family"))
    note = [F.col("pyramid_stage").alias("stage"), "name", F.coalesce("color_gradient", color).alias("color")]
    note_lists = ordered_children(notes, "product_id", [F.col("position_index"), F.col("name")], note, "_notes")
    strength = numbers.round_half_up(F.col("strength_score") * 100).cast("int").alias("pct")
    accord_lists = ordered_children(accords, "product_id", [F.col("position_index"), F.col("name")], ["name", color.alias("color"), strength], "_accords")
    alike = first_rows(reminds, [F.col("thumbs_up").desc_nulls_last(), F.col("remind_id")], SIMILAR)
    tone = F.element_at(F.array(*map(F.lit, TONES)), (F.col("_n") - 1) % len(TONES) + 1)
    alike = ordered_children(alike, "product_id", [F.col("_n")], [F.coalesce("external_product_name", F.lit("Linked candle")).alias("name"), F.col("external_brand_name").alias("brand"), tone.alias("tone"), F.col("external_source_url").alias("url")], "similar")
    house = brands.select("brand_id", F.col("name").alias("brand"), F.col("slug").alias("brand_slug"), F.col("country").alias("brand_country"), F.col("website_url").alias("_site"))

    full = products.join(categories.select("category_id"), "category_id", "left_semi").join(house, "brand_id", "left")
    stored = ratings.select("product_id", "rating_avg", "rating_count")
    for part in (profiles.select("product_id", F.col("summary").alias("_phrase")), note_lists, accord_lists, *vote_parts(votes), stored, alike, *review_parts(reviews), *size_parts(sizes)):
        full = full.join(part, "product_id", "left")

    rating = F.when(F.col("_n") > 0, F.struct(F.col("_avg").alias("avg"), F.col("_n").alias("count")))
    rating = F.coalesce(rating, F.struct(F.col("rating_avg").alias("avg"), F.coalesce("rating_count", F.lit(0)).cast("long").alias("count")))
    stars = F.array(*[F.struct(F.lit(s).alias("stars"), numbers.percent(F.col(f"_star_{s}"), F.col("_n")).alias("pct")) for s in range(5, 0, -1)])
    cheapest, primary = F.col("cheapest"), F.col("primary_size")
    price = display.price_label(cheapest["price_amount"], cheapest["price_currency"])
    own = F.struct(F.col("brand").alias("name"), F.lit("The house").alias("kind"), price.alias("price"), F.col("_site").alias("url"))
    others = F.filter("shops", lambda s: ~s["source_url"].eqNullSafe(F.col("_site")))
    others = F.transform(others, lambda s: F.struct(display.stockist(s["source_url"]).alias("name"), F.lit("Stockist").alias("kind"), display.price_label(s["price_amount"], s["price_currency"]).alias("price"), s["source_url"].alias("url")))
    nothing = F.array().cast("array<struct<name:string,kind:string,price:string,url:string>>")
    specs = {
        "Burn time": F.concat(display.plain_number(primary["burn_time_hours"]), F.lit(" hrs")),
        "Weight": display.size_label(primary["size_value"], primary["size_unit"], primary["size_grams"]),
        "Dimensions": F.lit(None).cast("string"),
        "Wax type": F.col("wax_type"),
        "Vessel": F.col("vessel_material"),
        "Wick": F.lit(None).cast("string"),
        "Released": F.col("release_year").cast("string"),
        "Made in": F.col("brand_country"),
    }
    listed = F.coalesce("_accords", F.array().cast(accord_lists.schema["_accords"].dataType))
    return full.select(
        "product_id", "name", "brand", "brand_slug", "brand_country",
        F.when(F.size(listed) > 0, F.array_join(F.slice(listed["name"], 1, 2), " · ")).alias("scent_type"),
        F.col("release_year").alias("year"), price.alias("from_price"), F.coalesce("description", "_phrase").alias("summary"), rating.alias("rating"),
        note_groups(F.coalesce("_notes", F.array().cast(note_lists.schema["_notes"].dataType))).alias("pyramid"),
        accord_bars(listed).alias("accords"),
        F.transform(F.slice(listed, 1, CHIPS), lambda a: F.struct(a["name"].alias("name"), a["color"].alias("color"))).alias("accord_chips"),
        F.coalesce("votes", F.array()).alias("votes"),
        _bars(SEASONS, "_s").alias("seasons"), _bars({half: name for half, (name, _) in HALVES.items()}, "_t").alias("day_night"),
        F.array(*[F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in specs.items()]).alias("specs"),
        F.concat(F.when(F.col("_site") != "", F.array(own)).otherwise(nothing), F.coalesce(others, nothing)).alias("stockists"),
        F.coalesce("similar", F.array()).alias("similar"), F.coalesce("reviews", F.array()).alias("reviews"),
        F.when(F.col("_n") > 0, stars).alias("rating_dist"),
    )
