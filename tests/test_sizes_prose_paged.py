import json

from pyspark.sql import functions as F

from quern.functions import prose
from quern.operators import sizes
from quern.sources import paged

GOOD = "A warm and generous candle that fills the room with cedar, smoke and resin."
LONG = "Poured by hand in small batches, this candle burns slowly and evenly and carries notes of cedar, smoke and resin."


def test_description(spark):
    texts = [
        f"Shop\n{GOOD}\n\nMore information\n{LONG}\nWeight: 190 g",
        f"Shop\n\nProduct details\n{LONG}\nBurn time: 40 hours",
        f"Menu\n\nShort.\n\n{GOOD}\n\n{LONG}",
        "Menu\n\nShort.",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.v for r in df.orderBy("i").select(prose.description_in(F.col("x")).alias("v")).collect()]
    assert got == [f"{GOOD}\n\n{LONG}", LONG, LONG, None, None, None]


def test_pick_description(spark):
    rows = [(0, GOOD, LONG, None), (1, "short", None, f"x\n\n{LONG}"), (2, "short", "tiny", None), (3, None, " ", None)]
    df = spark.createDataFrame(rows, "i int, a string, b string, page string")
    got = [r.v for r in df.orderBy("i").select(prose.pick_description(F.col("a"), F.col("b"), F.col("page")).alias("v")).collect()]
    assert got == [LONG, LONG, "short", None]


SWATCHES = "product_id int, place int, size string, sku string, available boolean, is_selected boolean, source_url string"
OFFER = "product_id int, place int, size string, sku string, price long, currency string, availability string, burn_time_hours int, source_url string"


def test_sizes_from_swatches_and_listed(spark):
    swatches = spark.createDataFrame([
        (1, 0, "70g", "A", True, False, "u0"), (1, 1, "70G", "a", True, True, "again"), (1, 2, "190g", None, False, True, "u2"),
        (1, 3, "600g", "C", None, None, None), (1, 4, None, None, True, True, "nothing"),
    ], SWATCHES)
    offers = spark.createDataFrame([(1, 0, "70g", "A", 1, "GBP", None, None, "old"), (1, 1, "x", "a", 2, "GBP", None, 20, "new"), (1, 2, "190G", "B", 3, "GBP", "InStock", 60, None)], OFFER)
    got = sizes.from_swatches(swatches, offers)
    assert [tuple(r) for r in got.orderBy("place").select("size", "sku", "price", "availability", "source_url", "is_primary").collect()] == [
        ("70g", "A", 2, None, "new", True), ("190g", "B", 3, "InStock", "u2", True), ("600g", "C", None, None, None, False),
    ]
    listed = spark.createDataFrame([
        (1, 0, "600g", "C", 9, None, None, None, None, 600), (1, 1, "x", "c", 8, "EUR", None, None, None, None),
        (1, 2, "1kg", None, 12, "EUR", None, None, None, 1000), (1, 3, "set", "S", 5, None, None, None, None, None), (2, 0, "50g", None, 1, None, None, None, None, 50),
    ], OFFER + ", grams int")
    full = sizes.fill(got, listed).orderBy("product_id", "place")
    assert [tuple(r) for r in full.select("product_id", "place", "size", "price", "currency", "is_primary").collect()] == [
        (1, 0, "70g", 2, "GBP", True), (1, 1, "190g", 3, "GBP", True), (1, 2, "600g", 9, "EUR", False), (1, 3, "1kg", 12, "EUR", False), (2, 0, "50g", 1, None, True),
    ]
    assert sizes.fill(got.limit(0), listed.limit(0)).count() == 0


def test_paged_catalogue(spark, tmp_path):
    pages = [["a", "b"], ["b", "c"], ["d", None], ["e"], ["late", "later"]]
    for n, handles in enumerate(pages, 1):
        (tmp_path / f"{n}.json").write_text(json.dumps({"products": [{"handle": h, "n": n} for h in handles]}))
    url = f"file://{tmp_path}/{{page}}.json"
    rows = paged.read_catalogue(spark, url, pages=6, page_size=2).orderBy("page", "place").collect()
    assert [(r.page, r.handle) for r in rows] == [(1, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]
    assert json.loads(rows[1].product) == {"handle": "b", "n": 1}
    assert [r.handle for r in paged.read_catalogue(spark, url, pages=6, page_size=2, most=2).collect()] == ["a", "b"]
    (tmp_path / "2.json").write_text("no json")
    assert [r.handle for r in paged.read_catalogue(spark, url, pages=6, page_size=2).orderBy("page", "place").collect()] == ["a", "b"]
