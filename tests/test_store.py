"""Imports as one write: statuses, sparse patches, children, documents, and files that stay."""

import os

from quern.operators import store, work

ROWS = "place int, slug string, name string, brand string, description string, notes array<string>, sizes array<struct<grams: int, price: long>>"


def files(place, name):
    return {os.path.join(os.path.basename(d), f) for d, _, found in os.walk(f"{place}/{name}") for f in found if f.endswith(".parquet")}


def load(spark, kept, *rows, **options):
    return {r.place: (r.slug, r.status, r.error) for r in kept.load(spark.createDataFrame(list(rows), ROWS), **options).collect()}


def test_import_rewrites_what_changed(spark, tmp_path):
    kept = store.Store(str(tmp_path / "s"), 32)
    first = [(i, f"p{i}", f"Name {i}", "B", "old", ["rose", "fig"], [(100, 5), (200, 9)]) for i in range(20)]
    assert set(load(spark, kept, *first).values()) == {(f"p{i}", "created", None) for i in range(20)}
    before = {name: files(tmp_path / "s", name) for name in store.TABLES}
    got = load(
        spark, kept,
        (1, "p3", "New name", None, None, ["oak"], None), (2, None, "Made Up!", None, None, None, [(50, 1)]), (3, None, " ", None, None, None, None), (4, None, "!!!", None, None, None, None),
        (5, "made-up", "Second", "C", None, None, None),
    )
    assert got == {1: ("p3", "updated", None), 2: ("made-up", "created", None), 3: (None, "failed", "name: required"), 4: (None, "failed", "slug: required"), 5: ("made-up", "updated", None)}
    assert [tuple(r)[:4] for r in kept.table(spark, "products").filter("slug in ('p3', 'made-up', 'p4')").orderBy("slug").collect()] == [("made-up", "Second", "C", None), ("p3", "New name", "B", "old"), ("p4", "Name 4", "B", "old")]
    assert [(r.position, r.note) for r in kept.table(spark, "notes").filter("slug = 'p3'").collect()] == [(0, "oak")]
    assert [(r.grams, r.is_primary) for r in kept.table(spark, "sizes").filter("slug = 'p3'").orderBy("position").collect()] == [(100, True), (200, False)]
    texts = {r.slug: r.text for r in kept.table(spark, "documents").collect()}
    assert texts["p3"] == "New name B oak old" and texts["made-up"] == "Second C" and texts["p4"] == "Name 4 B rose fig old" and len(texts) == 21
    after = {name: files(tmp_path / "s", name) for name in store.TABLES}
    gone = {name: {f.split("/")[0] for f in before[name] - after[name]} for name in store.TABLES}
    touched = {f"bucket={r.bucket}" for r in kept.table(spark, "products").filter("slug in ('p3', 'made-up')").collect()}
    assert all(g <= touched for g in gone.values()) and all(before[name] & after[name] for name in store.TABLES)


def test_import_again_and_skips(spark, tmp_path):
    kept = store.Store(str(tmp_path / "s"), 4)
    row = (1, "a", "A", "B", "t", [], [])
    load(spark, kept, row)
    assert load(spark, kept, row, (2, "b", "B", None, None, None, None), update_existing=False) == {1: ("a", "skipped", None), 2: ("b", "created", None)}
    assert load(spark, kept, row) == {1: ("a", "updated", None)}
    assert sorted(r.slug for r in kept.table(spark, "products").collect()) == ["a", "b"] and kept.table(spark, "sizes").count() == 0
    assert load(spark, kept) == {} and kept.table(spark, "products").count() == 2


def test_work_tables_are_cleared(spark):
    table = work.kept(spark.range(3).toDF("x"))
    place = table.inputFiles()[0].removeprefix("file:").split("/quern-work/")[0]
    assert table.count() == 3 and work.clear(spark)
    assert not os.path.exists(f"{place}/quern-work/{spark.sparkContext.applicationId}") and not work.clear(spark)
