import pytest
from pyspark.sql import functions as F

from quern.operators import writes


def test_patch_tells_null_from_absent(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, size int")
    changes = spark.createDataFrame([(1, None, True, None, False)], "id int, name string, has_name boolean, size int, has_size boolean")
    assert {tuple(r) for r in writes.patch(rows, changes, "id").collect()} == {(1, None, 5), (2, "b", 6)}


def test_upsert_nulls_are_distinct(spark):
    kind = "a int, b int, v string"
    old, new = spark.createDataFrame([(1, None, "o"), (1, 2, "o")], kind), spark.createDataFrame([(1, None, "n"), (1, 2, "n")], kind)
    assert sorted(r.v for r in writes.upsert(old, new, ["a", "b"]).collect()) == ["n", "n", "o"]


def test_ensure_fills_only_where_all_are_null(spark):
    kind = "slug string, color string, gradient string"
    old = spark.createDataFrame([("a", None, None), ("b", "#1", None)], kind)
    new = spark.createDataFrame([("a", "#2", "g"), ("b", "#2", "g"), ("c", "#3", None), ("c", "#4", None), (None, "#5", None)], kind)
    got = {r.slug: (r.color, r.gradient, r.created) for r in writes.ensure(old, new, "slug", ["color", "gradient"]).collect()}
    assert got == {"a": ("#2", "g", False), "b": ("#1", None, False), "c": ("#3", None, True)}


def test_first_approval_stamps(spark):
    rows = spark.createDataFrame([(1, "pending", None), (2, "pending", "old"), (3, "pending", None)], "review_id int, status string, published_at string")
    decided = spark.createDataFrame([(1, "approved"), (2, "approved"), (3, "rejected")], "review_id int, status string")
    got = {r.review_id: (r.status, r.published_at) for r in writes.moderate(rows, decided, F.lit("now")).collect()}
    assert got == {1: ("approved", "now"), 2: ("approved", "old"), 3: ("rejected", None)}


@pytest.mark.parametrize(("flags", "want"), [([False, True, True], [False, True, False]), ([None, False], [True, False]), ([], [])])
def test_one_primary(spark, flags, want):
    df = spark.createDataFrame([([(f, None) for f in flags],)], "x array<struct<is_primary:boolean,position:int>>")
    (r,) = df.select(writes.placed(writes.one_primary(F.col("x"))).alias("x")).collect()
    assert [i.is_primary for i in r.x] == want and [i.position for i in r.x] == list(range(len(want)))


def test_zip_rows(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x"], [])], "a array<string>, b array<string>, c array<string>")
    (r,) = df.select(writes.zip_rows(a=F.col("a"), b=F.col("b"), c=F.col("c")).alias("z")).collect()
    assert [tuple(z) for z in r.z] == [("a", "x", None), ("b", "x", None), ("c", "x", None)]


def test_constraints(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1), (2, None), (2, None), (3, 9)], "a int, b int")
    assert writes.repeated_keys(rows, ["a", "b"], F.col("b").isNotNull()).count() == 1
    assert [r.b for r in writes.orphans(rows, "b", spark.createDataFrame([(1,)], "id int"), "id").collect()] == [9]
