"""Declared schemas, uploads and assembly against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import catalogue, schema


def faults(spark, *documents):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)], "i int, d string")
    found = rows.select("i", schema.errors(F.try_parse_json("d")).alias("e")).collect()
    return {r.i: [(e.path, e.message) for e in r.e] for r in found}


def test_product_schema(spark):
    good = {"name": "A", "category_slug": "c", "release_year": 2001, "description": None, "sizes": [{"size_value": 1.5, "size_grams": None}], "images": [{"position": 0, "is_primary": False, "data_base64": "x"}], "notes": [], "more": {"a": [1]}}
    bad = good | {"name": None, "source_url": "no url", "brand_name": "", "is_discontinued": None, "release_year": 1.5, "sizes": [5, {"size_value": "1"}], "images": [{"position": -1}, {"position": 1, "is_primary": True}], "accords": [{"accord_slug": "", "name": "x", "color": "red"}]}
    got = faults(spark, good, bad, "[]", "7", "{", None, {})
    assert got[0] == []
    assert got[1] == [
        ("source_url", "not a url"), ("brand_name", "shorter than 1"), ("name", "expected text"), ("release_year", "not whole"), ("is_discontinued", "expected true or false"),
        ("sizes.0", "expected an object"), ("sizes.1.size_value", "expected a number"), ("images.0.position", "below 0"), ("images.0.is_primary", "required"),
        ("images.1", "Image must include source_url or data_base64"), ("accords.0.accord_slug", "shorter than 1"), ("accords.0.color", "not of the pattern"),
    ]
    assert got[2] == [("", "expected an object")] == got[3] and got[4] == [("", "not JSON")] == got[5]
    assert got[6] == [("category_slug", "required"), ("name", "required")]


def test_uploads(spark):
    product = {"name": "A", "category_slug": "c", "_timing": 1, "images": [1, 2]}
    files = {"none": "{", "object": "{}", "empty": "[]", "brandless": json.dumps([product]), "good": json.dumps([5, {"name": ""}, product, {"name": "x"}, product | {"brand_slug": "b", "_llm_error": None}, []])}
    products, invalid, told = schema.import_files(spark.createDataFrame(list(files.items()), "file string, text string"))
    got = {r.file: (r.brand_slug, r.brand_name, r.products, r.images, r.invalid, r.error) for r in told.collect()}
    assert got == {
        "none": (None, None, 0, 0, 0, "Invalid JSON file"), "object": (None, None, 0, 0, 0, "Expected a JSON array of products"), "empty": (None, None, 0, 0, 0, "File contains no products"),
        "brandless": (None, None, 1, 2, 0, "Could not detect brand_slug from import file"), "good": ("b", "b", 2, 4, 4, None),
    }
    assert [(r.file, r.place, json.loads(r.j)) for r in products.select("file", "place", F.to_json("record").alias("j")).orderBy("place").collect()] == [("good", 2, {"name": "A", "category_slug": "c", "images": [1, 2]}), ("good", 4, {"name": "A", "category_slug": "c", "images": [1, 2], "brand_slug": "b"})]
    assert [r.reason for r in invalid.filter("file = 'good'").orderBy("place").collect()] == ["Not an object", "Missing product name", "Missing category_slug", "Missing product name"]


def written(rows):
    """Assignments at paths, one after the other."""
    out = {}
    for path, value in rows:
        parts = [p for p in path.replace("[]", ".").split(".") if p]
        if not parts:
            continue
        here = out
        for p in parts[:-1]:
            if not isinstance(here.get(p), dict):
                here[p] = {}
            here = here[p]
        here[parts[-1]] = value
    return out


def test_assembly_equals_assignments(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for key in range(60):
        writes = [(".".join(rng.choice("abc") for _ in range(rng.randrange(0, 5))) + rng.choice(["", "[]", "."]), rng.choice([1, "x", None, [1, 2], True])) for _ in range(rng.randrange(1, 12))]
        rows += [(key, path, json.dumps(value), i) for i, (path, value) in enumerate(writes)]
        want[key] = written(writes)
    df = spark.createDataFrame(rows, "key int, path string, value string, place int").withColumn("value", F.parse_json("value"))
    got = {r.key: json.loads(r.j) for r in schema.assembled(df).select("key", F.to_json("record").alias("j")).collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert schema.assembled(df.filter("false")).count() == 0


def test_accents_in_natural_order(spark):
    names = ["Zoo 2", "Émile 10", "emile 9", "Ámber", "amber", "É", "f", "zoo 10"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    assert [r.x for r in df.orderBy(catalogue.natural_key(F.col("x")), "x").collect()] == ["amber", "Ámber", "É", "emile 9", "Émile 10", "f", "Zoo 2", "zoo 10"]


def test_records_are_parsed_once(spark):
    assert str(schema.errors(F.try_parse_json("d"))).count("try_parse_json(d)") == 1


def test_assembly_deals_its_rows_once(spark):
    rows = [(1, "a.b", "1", 1), (1, "a.c.d", "2", 2), (1, "e", "[3]", 3), (2, "a", "4", 1), (2, "a.b", "5", 2)]
    df = spark.createDataFrame(rows, "key int, path string, value string, place int").withColumn("value", F.parse_json("value"))
    for found in (schema.assembled(df), schema.assembled(df, 3)):
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert {r.key: json.loads(r.j) for r in found.select("key", F.to_json("record").alias("j")).collect()} == {1: {"a": {"b": 1, "c": {"d": 2}}, "e": [3]}, 2: {"a": {"b": 5}}}
    with pytest.raises(Exception, match="more than 2 parts"):
        schema.assembled(df, 2).collect()
