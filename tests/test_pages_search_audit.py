import random

import pytest
from pyspark.sql import functions as F

from quern.operators import audit, catalogue, pages, search
from quern.plans import more

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Product"], "name": "Fire", "sku": "s1", "offers": [{"price": "45.00", "priceCurrency": "EUR"}]}]}</script>'
    grid = "".join(f'<li class="tile big"><a href="/p/{i}">P{i}</a><img src="{i}.png"></li>' for i in range(4))
    html = f'<html><head>{ld}<script type="application/ld+json">{{bad</script></head><body><ul>{grid}</ul><p>Caf&eacute; &amp; co</p><a href="/p/1">again</a></body></html>'
    return spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")


def test_json_ld(shop):
    (row,) = pages.products(pages.json_ld(shop)).collect()
    assert (row.page_id, row.name, row.sku, row.price, row.currency) == (1, "Fire", "s1", "45.00", "EUR")


def test_json_ld_below_the_first_level(spark):
    deep = '{"a": ' * 3000 + "1" + "}" * 3000
    blocks = ['[{"@type": "Offer", "x": {"y": [{"@type": ["Thing", null, "PRODUCT"], "name": "in"}]}}, {"@type": "Product", "name": "out"}]', '{"mainEntity": {"@type": "product", "name": "main", "image": ["http://a", {"url": "", "contentUrl": "http://b"}, ["http://a", 3]]}}', "5", deep]
    rows = [(i, f'<script type="application/ld+json">{b}</script>') for i, b in enumerate(blocks)]
    nodes = pages.json_ld(spark.createDataFrame(rows, "page_id int, html string"))
    assert {(r.page_id, r.name, tuple(r.images or [])) for r in pages.products(nodes).collect()} == {(0, "in", ()), (1, "main", ("http://a", "http://b"))}


def test_text_and_links(shop):
    text = {r.page_id: r.t for r in shop.select("page_id", pages.page_text(F.col("html")).alias("t")).collect()}
    assert "Café & co" in text[1].split("\n") and "bad" not in text[1] and text[2] is None
    assert {(r.href, r.place) for r in pages.links(shop).collect()} == {(f"/p/{i}", i) for i in range(4)}


def test_elements(shop):
    nodes = pages.elements(shop)
    assert {(r.signature, r.members) for r in pages.repeated_groups(nodes).collect()} == {("li.big.tile", 4)}
    (best,) = pages.locate(nodes, {"href": "/p/2"}, "a").collect()
    assert best.text == "P2" and best.score == 3


@pytest.fixture(scope="module")
def furniture(spark):
    rows = [("item-lamp", "Tall Reading Lamp", "Harbour", "brass and linen", "brass shade switch"), ("item-desk", "Oak Desk", "Millwright", "oak with drawers", "oak drawer brass"), ("item-rug", "Rug", None, None, "wool")]
    return search.postings(spark.createDataFrame(rows, "product_id string, name string, brand string, description string, notes string"), "product_id", ["name", "brand", "description", "notes"])


def _terms(*texts, **how):
    return [search.Term(t, **how) for t in texts]


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ({"every": _terms("linen")}, "lamp"), ({"every": _terms("BRASS", "drawers")}, "desk"), ({"either": [_terms("linen", "wool")]}, "lamp rug"),
        ({"every": _terms("brass"), "without": _terms("oak")}, "lamp"), ({"every": _terms("oak desk")}, "desk"), ({"every": _terms("desk oak")}, ""),
        ({"every": _terms("har", prefix=True)}, "lamp"), ({"every": _terms("draw", field="notes", prefix=True)}, "desk"), ({"every": _terms("wool", field="description")}, ""),
        ({"either": [_terms("linen", "oak")], "without": _terms("drawer")}, "lamp"), ({"either": [_terms("linen", "oak"), _terms("brass", "wool")]}, "lamp desk"), ({"every": _terms("a-b")}, ""),
        ({}, ""), ({"every": _terms("?!")}, ""), ({"without": _terms("linen")}, ""), ({"every": _terms("brass and linen")}, "lamp"), ({"every": _terms("brass and li", prefix=True)}, "lamp"),
        ({"every": _terms("linen brass")}, ""), ({"every": _terms("wool", "?"), "without": _terms("", "oak")}, "rug"),
    ],
)
def test_search(furniture, asked, want):
    assert {r.product_id for r in search.search(furniture, "product_id", **asked).collect()} == {f"item-{w}" for w in want.split()}


def test_facets_against_plain_filters(spark):
    """Any of the notes, all of the voted options, at least the rating; then a page, best rated first."""
    rng = random.Random(21)
    items = {i: {"name": f"Item {i:02}", "category": rng.choice(["desk", "rug"]), "brand": rng.choice(["mill", "port"]), "rating": rng.choice([None, 10, 25, 40]), "notes": set(rng.sample("abcd", rng.randrange(3))), "votes": {o: rng.randrange(3) for o in rng.sample("xyz", 2)}} for i in range(40)}
    products = spark.createDataFrame([(i, x["name"], x["category"], x["brand"]) for i, x in items.items()], "product_id int, name string, category_slug string, brand_slug string")
    ratings = spark.createDataFrame([(i, x["rating"] / 10) for i, x in items.items() if x["rating"]], "product_id int, rating_avg double")
    notes = spark.createDataFrame([(i, n) for i, x in items.items() for n in x["notes"]], "product_id int, note string")
    votes = spark.createDataFrame([(i, o, n) for i, x in items.items() for o, n in x["votes"].items()], "product_id int, option string, votes int")
    for chosen in ({"category": "desk"}, {"brand": "mill", "min_rating": 2.5}, {"notes": ["a", "c"]}, {"votes": ["x", "y"]}, {"category": "rug", "notes": ["b"], "min_rating": 1.0, "votes": ["z"]}):
        want = [
            i for i, x in items.items()
            if x["category"] == chosen.get("category", x["category"]) and x["brand"] == chosen.get("brand", x["brand"]) and (x["rating"] or -1) / 10 >= chosen.get("min_rating", -1)
            and (not chosen.get("notes") or x["notes"] & set(chosen["notes"])) and all(x["votes"].get(o, 0) > 0 for o in chosen.get("votes", []))
        ]
        assert sorted(r.product_id for r in catalogue.facet(products, catalogue.Filters(**chosen), ratings, notes, votes).collect()) == want
    best = catalogue.Filters(category="desk", sort="rating", limit=3, offset=1)
    rated = [x["rating"] for x in items.values() if x["category"] == "desk"]
    page = catalogue.page(catalogue.facet(products, best, ratings, notes, votes), best).collect()
    assert [items[r.product_id]["rating"] for r in page] == sorted(rated, key=lambda r: -(r or 0))[1:4]


def test_audit(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    found = audit.findings(rows, "id", {"short": ("high", F.length("t") < 3), "never": ("low", F.lit(False))})
    assert {(r.id, r.check) for r in found.collect()} == {(1, "short"), (2, "short")}
    (r,) = audit.summary(found, "id").collect()
    assert (r.n, r.n_keys) == (2, 2)
    loop = spark.createDataFrame([("a line that is long enough to count\n" * 8,), ("short\n" * 20,), ("a line that is long enough to count\n" * 7,)], "t string")
    assert [r[0] for r in loop.select(audit.repetition_loop(F.col("t"))).collect()] == [True, False, False]


def test_worklist_prefers_slug(spark):
    lines = spark.createDataFrame([("Aqua di Roma", 0), ("Nor Dic", 1), ("None", 2)], "name string, place int")
    sites = spark.createDataFrame([("old", "aquadiroma", 1, True, 0), ("aqua-di-roma", "x", 0, False, 1), ("d", "Nordic", 2, False, 2)], "folder string, brand string, products int, assembled boolean, place int")
    got = {r.name: (r.folder, r.status) for r in audit.worklist(lines, sites).collect()}
    assert got == {"Aqua di Roma": ("aqua-di-roma", "configured"), "Nor Dic": ("d", "captured"), "None": (None, "not-started")}


@pytest.mark.parametrize("name", ["html_to_text", "dom_signature_groups", "locator_best"])
def test_page_queries_run(spark, name):
    assert getattr(more, name)(spark, SF).count() > 0
