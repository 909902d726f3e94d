import pytest
from pyspark.sql import functions as F

from quern.operators import product_audit as a

PRODUCTS = "place long, name string, slug string, source_url string, wax_type string, notes array<string>, prices array<long>, images array<string>, from_model boolean"
ENTRIES = "source_url string, place int, pass string, raw_response string, n_parsed int, n_parsed_notes int, kind string, name string, fallback boolean"


def _found(spark, products, entries=(), failures=()):
    e, f = spark.createDataFrame(list(entries), ENTRIES), spark.createDataFrame([(u,) for u in failures], "url string")
    return {(r.place, r.check, r.detail) for r in a.findings(spark.createDataFrame(products, PRODUCTS), e, f, ["soy"]).collect()}


def test_sound_product_has_no_findings(spark):
    product = (1, "Fir", "fir", "u", "soy", ["fir", "resin"], [None, 5], ["i"], False)
    assert _found(spark, [product], [("u", 0, "extract", '{"n": 1}', 1, 2, None, None, None)], ["other", None, ""]) == set()


def test_nulls_everywhere(spark):
    want = {(None, "missing_critical", f"no {what}") for what in ("name", "sizes", "images", "notes")}
    assert _found(spark, [(None,) * 9], [(None,) * 9, ("", 0, "color", None, None, None, None, None, True)], [None, ""]) == want
    assert _found(spark, []) == set()


def test_first_extract_entry_counts(spark):
    product = (1, "Fir", "fir", "u", None, ["fir"], [5], ["i"], None)
    entries = [("u", 3, "extract", "later", 0, 0, None, None, None), ("u", 1, "extract", "{", 0, 1, None, None, None), ("u", 0, "color", None, None, None, None, None, True), ("u", 2, "color", None, None, None, "note", "x", False)]
    got = _found(spark, [product], entries, ["u"])
    assert got == {(1, "pipeline_failure", "its url is in the failure log"), (1, "discarded_llm_response", "a reply came and nothing was read from it"), (1, "truncated_llm_output", "no closing brace"), (1, "fallback_color", "color:?")}


@pytest.mark.parametrize(
    ("name", "junk"),
    [("Bergamot", False), (" ", True), (None, True), ("x" * 40, False), ("x" * 41, True), ("Sage.", True), ("a b c d e", False), ("a b c d e f", True), ("Evokes the sea", True), ("Notes", True), ("At Home", True), ("Homely rose", False), ("candles", False)],
)
def test_junk_note(spark, name, junk):
    assert spark.createDataFrame([(name,)], "n string").select(a.junk_note(F.col("n"))).first()[0] is junk


@pytest.mark.parametrize(
    ("raw", "n_parsed", "why"),
    [("x" * 4096, None, "very long"), ("x" * 4096, 1, None), ("{" + "forty characters, over and over, without a line " * 8 + "}", 0, "repeats itself"), ("{" + "forty characters, over and over, without a line " * 7 + "}", 0, None), ("{} \n", None, None), (" \n", None, None), ("", None, None), (None, None, None), ("{'a'", None, "no closing brace")],
)
def test_reply_fault(spark, raw, n_parsed, why):
    row = spark.createDataFrame([(raw, n_parsed)], "r string, n int").select(a.reply_fault(F.col("r"), F.col("n"))).first()
    assert row[0] == why


def test_duplicates(spark):
    rows = [(i, "n", s, u, None, [], [], [], False) for i, s, u in ((1, "a", "u"), (2, "a", "v"), (3, "b", "u"), (4, None, ""), (5, None, ""), (6, "a", None))]
    p = spark.createDataFrame(rows, PRODUCTS)
    assert {tuple(r) for r in a.duplicates(p).collect()} == {("slug", "a", 1, 3), ("source_url", "u", 1, 2)}
    assert {tuple(r) for r in a.members(p).collect()} == {("slug", "a", 1), ("slug", "a", 2), ("slug", "a", 6), ("source_url", "u", 1), ("source_url", "u", 3)}


def test_replies_are_judged_before_they_are_dealt(spark):
    plan = a.findings(spark.createDataFrame([], PRODUCTS), spark.createDataFrame([], ENTRIES), spark.createDataFrame([], "url string"), ["soy"])._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "raw_response" in line and ("Exchange" in line or "Aggregate" in line or "Sort " in line)]
