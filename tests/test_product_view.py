"""The product document on small rows: fall-backs, ties, nulls, products without children, hot products."""

import pytest
from pyspark.sql import functions as F

from quern.functions import display
from quern.operators import product_view as pv

SCHEMAS = {
    "products": "product_id long, name string, category_id long, brand_id long, description string, wax_type string, vessel_material string, release_year int",
    "categories": "category_id long",
    "brands": "brand_id long, name string, slug string, country string, website_url string",
    "profiles": "product_id long, summary string",
    "notes": "product_id long, position_index int, name string, pyramid_stage string, color string, color_gradient string, note_family string",
    "accords": "product_id long, position_index int, name string, strength_score double, color string, note_family string",
    "votes": "product_id long, dimension_slug string, dimension_name string, option_slug string, option_label string, sort_order int, vote_count long",
    "ratings": "product_id long, rating_avg double, rating_count long",
    "reminds": "product_id long, remind_id long, thumbs_up int, external_product_name string, external_brand_name string, external_source_url string",
    "reviews": "product_id long, review_id long, status string, rating double, author_name string, title string, body string, published_at date, created_at date",
    "sizes": "product_id long, size_id long, position int, is_primary int, size_grams int, size_value double, size_unit string, burn_time_hours double, price_amount long, price_currency string, source_url string",
}


def built(spark, **rows):
    tables = {name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()}
    return {r.product_id: r for r in pv.product_view(**tables).collect()}


ONE = dict(products=[(1, "Fig", 1, 1, None, "soy", None, 2020), (2, "Bare", 1, None, None, None, None, None), (3, "No shelf", 9, 1, None, None, None, None)], categories=[(1,)], brands=[(1, "Acre", "acre", "FR", "https://acre.test/")])


def test_a_product_without_children_keeps_its_row(spark):
    got = built(spark, **ONE)
    assert sorted(got) == [1, 2]  # a category that isn't there leaves no page
    bare = got[2]
    assert (bare.brand, bare.from_price, bare.summary, bare.scent_type, tuple(bare.rating), bare.rating_dist) == (None, None, None, None, (None, 0), None)
    assert all(getattr(bare, c) == [] for c in ("pyramid", "accords", "accord_chips", "votes", "stockists", "similar", "reviews"))
    assert [tuple(s) for s in bare.seasons][0] == ("Spring", "spring", 0, 0) and [tuple(h) for h in bare.day_night] == [("Day", "day", 0, 0), ("Night", "night", 0, 0)]
    assert [tuple(s) for s in got[1].stockists] == [("Acre", "The house", None, "https://acre.test/")]
    assert built(spark) == {}


def test_sizes_choose_primary_price_and_shops(spark):
    sizes = [
        (1, 1, 2, 0, 200, None, None, 40.0, 4500, None, "https://www.shop.test/a"), (1, 2, 1, 0, 100, 3.5, "oz", None, 4500, "EUR", "https://acre.test/"),
        (1, 3, 2, 1, 70, None, None, 20.5, 5050, "USD", "https://www.shop.test/a"), (1, 4, None, None, None, None, None, None, None, None, ""), (1, 5, 9, 1, 1, None, None, None, None, None, "not a url"),
    ]
    r = built(spark, **ONE, sizes=sizes)[1]
    # the first flagged size is shown; the cheapest is the first of equal price in order
    assert [s.value for s in r.specs] == ["20.5 hrs", "70g", None, "soy", None, None, "2020", "FR"] and r.from_price == "€45"
    assert [tuple(s) for s in r.stockists] == [("Acre", "The house", "€45", "https://acre.test/"), ("Shop", "Stockist", "US$50.50", "https://www.shop.test/a"), ("Stockist", "Stockist", None, "not a url")]


def test_notes_and_accords_in_stages_and_colors(spark):
    notes = [(1, 2, "oud", "base", None, None, "Dry WOODY musk"), (1, 1, "fig", "Heart", "#010203", None, "green"), (1, 1, "bay", "middle", "", "linear", "green"), (1, None, "sap", None, None, None, None), (1, 3, "zest", "drydown", None, None, "citrus")]
    accords = [(1, 1, "fresh", None, None, "aquatic"), (1, 2, "warm", 0.305, "#040506", None), (1, 3, "soft", 0.9, None, None), (1, 4, "dry", 0.31, None, None)]
    r = built(spark, **ONE, notes=notes, accords=accords, profiles=[(1, "a phrase")])[1]
    assert [(g.stage, [tuple(n) for n in g.notes]) for g in r.pyramid] == [("Heart", [("bay", "linear"), ("fig", "#010203")]), ("Base", [("oud", "#8b7355")]), ("Other", [("sap", display.PLAIN_COLOR), ("zest", "#e8c547")])]
    assert [(a.name, a.pct) for a in r.accords] == [("soft", 90), ("warm", 31), ("dry", 31), ("fresh", None)] and r.accord_chips[0].color == "#6ba3c4"
    assert (r.scent_type, r.summary) == ("fresh · warm", "a phrase")


def test_votes_are_shared_by_dimension(spark):
    votes = [(1, "season", "Season", "winter", "Winter", 4, 3), (1, "season", "Season", "monsoon", "M", 5, 1), (1, "time_of_day", "Time", "morning", "Morning", 1, 1), (1, "time_of_day", "Time", "night", "Night", 4, 2), (1, "sillage", "Sillage", "soft", "Soft", 2, 1), (1, "sillage", "Sillage", "loud", "Loud", 1, 2), (1, "longevity", "Longevity", "x", "X", 1, 0)]
    r = built(spark, **ONE, votes=votes)[1]
    assert [(s.option_slug, s["count"], s.pct) for s in r.seasons] == [("spring", 0, 0), ("summer", 0, 0), ("autumn", 0, 0), ("winter", 3, 75)]
    assert [(h["count"], h.pct) for h in r.day_night] == [(1, 33), (2, 67)]
    assert [(v.dimension, v.total, [tuple(o) for o in v.options]) for v in r.votes] == [("Longevity", 0, [("X", 0)]), ("Sillage", 3, [("Loud", 67), ("Soft", 33)])]


def test_reviews_and_reminds_of_a_hot_product(spark):
    """2,000 reviews and similar products of one product: the first are shown, the mean is of all."""
    import datetime as dt

    day = dt.date(2020, 1, 1)
    reviews = [(1, i, "approved" if i % 2 else "pending", [None, 4.0, 2.5][i % 3], None if i % 4 else "A", None, f"b{i}", None if i % 5 == 0 else day + dt.timedelta(i % 7), day + dt.timedelta(i % 3)) for i in range(2000)]
    reminds = [(1, i, None if i == 7 else i % 10, None if i % 2 else f"n{i}", None, None) for i in range(2000)]
    r = built(spark, **ONE, reviews=reviews, reminds=reminds, ratings=[(1, 1.0, 9), (2, 3.5, 2)])
    approved = [x for x in reviews if x[2] == "approved"]
    far = dt.date(1, 1, 1)
    want = sorted(approved, key=lambda x: (-(x[7] or far).toordinal(), -x[8].toordinal(), x[1]))[:6]
    assert [(v.author, v.rating, v.body) for v in r[1].reviews] == [(x[4] or "Anonymous", x[3], x[6]) for x in want]
    rated = [x[3] for x in approved if x[3] is not None]
    assert r[1].rating["count"] == len(rated) and r[1].rating.avg == pytest.approx(sum(rated) / len(rated)) and tuple(r[2].rating) == (3.5, 2)
    # 2.5 rounds up to three stars
    assert {d.stars: d.pct for d in r[1].rating_dist} == {5: 0, 4: round(100 * rated.count(4.0) / len(rated)), 3: round(100 * rated.count(2.5) / len(rated)), 2: 0, 1: 0}
    assert [(s.name, s.tone) for s in r[1].similar] == [("Linked candle", "olive"), ("Linked candle", "espresso"), ("Linked candle", "oxblood"), ("Linked candle", "stone")]


def test_family_colors(spark):
    rows = [("CITRUS and floral", "#e8c547"), (None, display.PLAIN_COLOR), ("", display.PLAIN_COLOR), ("wood", display.PLAIN_COLOR)]
    got = spark.createDataFrame(rows, "family string, want string").select(display.entity_color(F.lit(None).cast("string"), F.col("family")).alias("c"), "want").collect()
    assert all(r.c == r.want for r in got)
