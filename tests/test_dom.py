"""Element trees, groups and locators against plain Python over small pages."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quern.operators import dom, pages
from quern.plans import dom as plans

PAGES = "page_id long, url string, html string"


def nodes_of(spark, *html):
    rows = [(i, "https://shop.example.org/x", h) for i, h in enumerate(html)]
    return dom.elements(dom.trees(spark.createDataFrame(rows, PAGES)))


def test_tree_of_broken_html(spark):
    html = """<body><p>Hello <b>bold</b> world &amp; &eacute;&#233;&#x1F600; &zzz;<p>x<p>y<ul><LI class='t a12' CLASS=z data-x="a > b">x<li>y<img src=a.png></ul></i>
<table><tr><td>1<td>2<tr><td>3</table><!-- <p>no --><script>var a="<p>no"</script><select><option>a<option selected>b</select>"""
    rows = {r.node: r for r in nodes_of(spark, html, None, "", "just text <").collect() if r.page_id == 0}
    assert [r.tag for _, r in sorted(rows.items())] == "body p b p p ul li li img table tr td td tr td script select option option".split()
    assert rows[1].text == "Hello bold world & éé😀 &zzz;" and rows[3].text == "x" and rows[4].text == "y"
    assert rows[6].attrs == {"class": "t a12", "data-x": "a > b"} and rows[8].attrs == {"src": "a.png"} and rows[18].attrs == {"selected": ""}
    assert (rows[5].last, rows[5].text, rows[9].last, rows[9].text) == (8, "xy", 14, "123")
    assert rows[14].path == ["table:nth-of-type(1)", "tr:nth-of-type(2)", "td:nth-of-type(1)"] and rows[14].ancestors == [0, 9, 13]
    for r in rows.values():  # intervals are descendants
        assert {x.node for x in rows.values() if r.node in x.ancestors} == set(range(r.node + 1, r.last + 1))


def test_regions_and_common_ancestors(spark):
    html = '<body><header><a>1</a></header><div class="x page-main"><p><a>2</a><a>3</a></p><div role="navigation"><a>4</a></div></div><a id="content">5</a>'
    rows = nodes_of(spark, html).filter("tag = 'a'")
    assert [(r.text, r.chrome, r.main) for r in rows.orderBy("node").collect()] == [("1", True, False), ("2", False, True), ("3", False, True), ("4", True, True), ("5", False, True)]
    found = dom.common_ancestors(rows.withColumn("g", F.explode(F.array(F.lit("all"), F.when(F.col("text").isin("2", "3"), "p").when(F.col("text") == "4", "self").otherwise("all")))), ["g"])
    assert {r.g: r.ancestor for r in found.collect()} == {"all": 0, "p": 4, "self": 8}


def test_fragmented_grid(spark):
    """Blocks of one grid are one group; variants join, the promo and the carousel don't, and a menu stays exact."""
    tile = lambda i, extra="": f'<li class="cell main-cell{extra}" data-key="9{i}-a"><div class="pic"><a class="go" href="/p/{i}"><img src=x></a><p>Candle number {i}</p></div></li>'
    sizes, n, blocks = [7] * 11 + [5, 4], 0, ""
    for size in sizes:
        blocks += "<div class='block'><ul>"
        for _ in range(size):
            blocks += tile(n, " badge" if n % 9 == 4 else "")
            n += 1
        blocks += "<li class='promo'>Read our letter now</li></ul></div>"
    slides = "".join(f'<div class="slide"><div class="cell main-cell side" data-key="x{i}"><a href="/c/{i}"><img src=y></a>Carousel</div></div>' for i in range(4))
    menu = "".join(f'<li class="entry{" open" if i == 2 else ""}"><a href="/m/{i}">Menu {i}</a></li>' for i in range(6))
    nodes = nodes_of(spark, f"<body><nav><ul>{menu}</ul></nav><main>{blocks}<aside>{slides}</aside></main>").cache()
    groups = {r.signature: r for r in dom.repeated_groups(nodes).collect()}
    grid = groups["li[c~cell|c~main-cell|data-key]"]
    tags = {r.node: r for r in nodes.collect()}
    assert len(grid.members) == n and all("cell" in tags[i].attrs["class"] and tags[i].tag == "li" for i in grid.members)
    assert tags[grid.container].tag == "main" and grid.score == n + 8 + n + 6 and grid.rank == 1
    assert len(groups["div[c~slide]"].members) == 4
    assert len(groups["li[c~entry]"].members) == 5 and groups["li[c~entry]"].score == 5 + 8 + 5 - 10


def test_overlaps_of_paths(spark):
    rng = random.Random(4)
    paths = [[rng.choice("abc") for _ in range(rng.randrange(0, 7))] for _ in range(60)]
    rows = [(a, b) for a in paths[:30] for b in paths[30:]]

    def strict(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
            n += 1
        return n

    def tolerant(a, b):
        a, b, n, skips = list(a), list(b), 0, 2
        while a and b:
            if a[-1] == b[-1]:
                a.pop(), b.pop()
                n += 1
            elif skips and len(a) > 1 and a[-2] == b[-1]:
                a.pop()
                skips -= 1
            elif skips and len(b) > 1 and a[-1] == b[-2]:
                b.pop()
                skips -= 1
            else:
                break
        return n

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", dom.tail_overlap(F.col("a"), F.col("b")).alias("s"), dom.tolerant_overlap(F.col("a"), F.col("b")).alias("t")).collect()
    assert all((r.s, r.t) == (strict(r.a, r.b), tolerant(r.a, r.b)) for r in got)


def scored(node, recipe):
    """Score and evidence of one element by the rules, for recipes without anchors."""
    kept = {k: v for k, v in node.attrs.items() if k.startswith("data-") and not v.isdigit() and k != "data-id" or k in ("itemprop", "role")}
    words = [w for w in node.attrs.get("class", "").split() if not re.search(r"\d{3,}", w)][:4]
    if words and not re.search(r"\d{3,}", node.attrs["class"]):
        kept["class"] = " ".join(words)
    target = recipe["attrs"].get("class", "").split()
    covers = bool(target) and set(target) <= set(kept.get("class", "").split())
    score, sure = 2 * (node.tag == recipe["tag"]), 0
    for k, v in recipe["attrs"].items():
        if kept.get(k) == v:
            score, sure = score + 6, sure + (5 if k == "class" or not target or covers else 0)
        elif k == "class" and covers:
            score, sure = score + 4, sure + 2
    sample = recipe["text"]
    if sample and node.text:
        score, sure = (score + 6, sure + 3) if node.text == sample else (score + 3, sure + 1) if sample in node.text or node.text in sample else (score, sure)
    steps, n = [s for s in recipe["path"].split(" > ") if s], 0
    while n < min(len(steps), len(node.path)) and steps[-1 - n] == node.path[-1 - n]:
        n += 1
    score, sure = score + 2 * n, sure + (min(n, 5) if n >= 2 else 0)
    return score + 5 * node.main - 8 * node.chrome + 8 * node.detail - 10 * node.recommendation, sure


def test_locators_against_all_elements(spark):
    rng = random.Random(8)
    piece = lambda: rng.choice(['<p class="{0} note">{1}</p>', '<span data-role="{0}">{1}</span>', '<div class="{0} box"><span class="{1}">{0}</span>', "</div>", '<p itemprop="{1}" class="{0} k1234">{0} {1}</p>', "<section>", "</section>", "<nav>", "</nav>", '<div class="product-detail">']).format(rng.choice("xyz"), rng.choice("uvw"))
    html = ["<body><main>" + "".join(piece() for _ in range(40)) for _ in range(12)]
    nodes = nodes_of(spark, *html).cache()
    held = nodes.collect()
    recipes = []
    for i in range(25):
        of = rng.choice(held)
        attrs = {k: v for k, v in of.attrs.items() if rng.random() < 0.7}
        recipes.append({"recipe": f"r{i}", "tag": of.tag, "attrs": attrs, "text": of.text[:30] if rng.random() < 0.5 else None, "path": " > ".join(of.path[rng.randrange(3) :])})
    rows = [(r["recipe"], r["tag"], r["attrs"], r["text"], r["path"], {}, None, None) for r in recipes]
    got = {(r.recipe, r.page_id): (r.node, r.score, r.evidence) for r in dom.locate(nodes, spark.createDataFrame(rows, plans.RECIPES)).collect()}
    want = {}
    for r in recipes:
        for page in range(len(html)):
            best = None
            for n in (x for x in held if x.page_id == page):
                used = {k: v for k, v in r["attrs"].items() if (k.startswith("data-") or k in ("class", "itemprop")) and v}
                chosen = bool(used) and all(set(v.split()) <= set(n.attrs.get("class", "").split()) if k == "class" else n.attrs.get(k) == v for k, v in used.items())
                if not chosen and n.tag != r["tag"]:
                    continue
                score, sure = scored(n, r)
                if sure >= 5:
                    best = max([b for b in (best, (score, chosen, -n.node, sure)) if b])
            if best:
                want[r["recipe"], page] = (-best[2], best[0], best[3])
    assert got == want and len(want) > 20


def test_anchors_media_and_values(spark):
    page = '<body><main><div data-kind="gallery"><a href="/z"><img src="/1.jpg"></a></div><div data-kind="two"><a href="/b1">x</a></div><div data-kind="two"><a href="/b2">y</a></div></main>'
    rows = [
        ("one", "a", {}, None, None, {"data-kind": "gallery"}, "a", "href"),
        ("two", "a", {}, None, None, {"data-kind": "two"}, "a", "href"),  # two anchors: the first scores more
        ("gone", "b", {}, None, None, {"data-kind": "gallery"}, "b", None),
    ]
    got = {r.recipe: (r.value, r.evidence) for r in dom.locate(nodes_of(spark, page), spark.createDataFrame(rows, plans.RECIPES)).collect()}
    assert got["one"][0] == "/z" and got["two"] == ("/b1", 8) and "gone" not in got


def test_odd_tables(spark):
    empty = spark.createDataFrame([], PAGES)
    nodes = dom.elements(dom.trees(empty))
    assert nodes.count() == 0 and dom.repeated_groups(nodes).count() == 0
    assert dom.locate(nodes, plans.recipes(spark)).count() == 0
    deep = "<div>" * 400 + "x" + "<p>" * 3
    assert nodes_of(spark, deep).agg(F.max(F.size("ancestors"))).first()[0] == 400
    assert pages.elements(spark.createDataFrame([(1, "<p>a<p>b")], "page_id long, html string")).select("path", "text").collect()[1] == ("/p", "b")


def test_nodes_are_never_sent_to_every_task(spark):
    """A table of nodes is small in its files and large in memory: only recipes are broadcast."""
    rows = [(i, "u", f'<html><body><main><h1 class="title big" id="p{i}">x{i}</h1></main></body></html>') for i in range(40)]
    found = dom.locate(dom.elements(dom.trees(spark.createDataFrame(rows, PAGES))), plans.recipes(spark))
    lines, below, scanned = found._jdf.queryExecution().executedPlan().toString().split("\n"), None, []
    for line in lines:
        deep = len(re.match(r"[\s:+*()\d-]*", line)[0])
        below = None if below is not None and deep <= below else below
        if "BroadcastExchange" in line and below is None:
            below = deep
        elif below is not None and "FileScan" in line:
            scanned.append(line)
    assert any("BroadcastExchange" in line for line in lines) and not scanned
    assert found.filter("recipe = 'title'").count() == 40


def test_a_page_is_read_in_pieces(spark):
    """A page of many tiles is no single row: its nodes leave as they close, and batches may end anywhere in it."""
    tiles = "".join(f'<li class="tile" data-key="k{i}"><a href="/p/{i}">name {i}<p>x<p>y</li>' for i in range(30))
    html = [f"<!doctype html><body><main><ul>{tiles}</ul></main>", "<p>b<div>c", None, f"<ul>{tiles}"]
    fields = ["page_id", "node", "parent", "last", "nth", "ancestors", "tag", "attrs", "text", "path", "main", "in_chrome"]
    grown = lambda: sorted((r.asDict() for r in nodes_of(spark, *html).select(*fields).collect()), key=lambda r: (r["page_id"], r["node"]))
    whole = grown()
    assert len(whole) == 3 + 120 + 2 + 1 + 120 and [r["text"] for r in whole if r["tag"] == "main"] == ["".join(f"name {i}xy" for i in range(30))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert grown() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(1, "u", html[0])], PAGES)
    assert dom.trees(df).count() == 123
    table = pa.table({"first": [True] + [False] * 90, "kind": ["s"] * 91, "tag": ["ul"] + ["li"] * 90, "own": [0] * 91, "text": [None] * 91, "page_id": [1] * 91})
    assert [b.num_rows for b in dom._grow(iter(table.to_batches(max_chunksize=13)))] == [11, 13, 13, 13, 13, 13, 13, 2]


def test_groups_of_bare_elements(spark):
    """Elements without classes are alike by their first six children; no window holds an element's children, and few are gathered."""
    rng = random.Random(2)
    cells = [[rng.choice("bi") for _ in range(rng.choice([1, 2, 8, 9]))] for _ in range(60)] + [["i"] * 7 + ["b"] * 9] * 3
    nodes = nodes_of(spark, "<body><main>" + "".join("<section>" + "".join(f"<{t}>some words</{t}>" for t in c) + "</section>" for c in cells) + "</main>")
    found = dom.repeated_groups(nodes)
    signed = [f"section{{{','.join(c[:6])}}}" for c in cells]
    most = max(signed, key=lambda x: (signed.count(x), -signed.index(x)))
    assert {r.signature: (len(r.members), r.score) for r in found.collect()} == {most: (signed.count(most), signed.count(most) + 6)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("row_number" in line for line in plan.split("\n") if re.search(r"\bWindow \[", line))
