"""Resumable extraction: broken tries, reruns, targeted replacements; replies that are asked once."""

import os

import pytest
from pyspark.sql import functions as F

from quern.operators import records
from quern.plans import launching
from quern.streaming import extraction

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def extracted(pages):
    return extraction.extract(pages, F.col("url"), launching.page_fields())


def told(df):
    return sorted(map(str, df.collect()))


class Broken(extraction.Sink):
    """Stops after the products of the second batch were written and before its failures are."""

    def append(self, found, batch, order=None):
        super().append(found, batch, order)
        if batch == 1 and not os.path.exists(f"{self.place}/stopped"):
            open(f"{self.place}/stopped", "w").close()
            raise RuntimeError("executor lost")


def test_kill_and_resume(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = pages.union(pages.limit(7)).union(spark.createDataFrame([(1, None, "<h1>x</h1>"), (2, "u2", "Access denied"), (3, "u3", None)], PAGES))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    broken, clean = Broken(str(tmp_path / "a")), extraction.Sink(str(tmp_path / "b"))
    query = extraction.run(stream(), broken, extracted, str(tmp_path / "ca"))
    with pytest.raises(Exception, match="executor lost"):
        query.awaitTermination(240)
    for sink, kept in ((broken, "ca"), (clean, "cb"), (clean, "cb")):  # goes on, runs through, and has nothing left to do
        query = extraction.run(stream(), sink, extracted, str(tmp_path / kept))
        assert query.awaitTermination(240)
    assert told(broken.products(spark).select("key")) == told(clean.products(spark).select("key"))
    assert broken.products(spark).groupBy("key").count().filter("count > 1").count() == 0
    assert told(broken.failures(spark)) == told(clean.failures(spark))
    assert {r.reason for r in clean.failures(spark).collect()} >= {"no key", "blocked", extraction.NO_NAME}


def test_replace_touches_its_folders_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i}", f"<h1>old {i}</h1>") for i in range(1, 40) if i % 3], PAGES)
    sink = extraction.Sink(str(tmp_path / "s"), buckets=8)
    sink.append(extracted(rows), 0)
    new = spark.createDataFrame([(1, "u1", "<h1>new</h1>"), (2, "u2", "")], PAGES)
    for _ in range(2):
        sink.replace(extracted(new))
    first = {f: os.path.getmtime(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "s/replaced") for f in files if f.endswith(".parquet")}
    assert len([d for d in os.listdir(tmp_path / "s/replaced") if d.startswith("bucket=")]) == 1
    got = {r.key: r.record.name for r in sink.products(spark).collect()}
    assert got == {f"u{i}": "new" if i == 1 else f"old {i}" for i in range(1, 40) if i % 3}
    bucket = lambda k: spark.range(1).select(F.pmod(F.xxhash64(F.lit(k)), F.lit(8)).alias("b")).first().b
    other = next(f"u{i}" for i in range(2, 40) if i % 3 and bucket(f"u{i}") != bucket("u1"))
    sink.replace(extracted(spark.createDataFrame([(int(other[1:]), other, "<h1>newer</h1>")], PAGES)))
    second = {f for _, _, files in os.walk(tmp_path / "s/replaced") for f in files if f.endswith(".parquet")}
    assert set(first) <= second  # the other folder's files keep their names
    got = {r.key: r.record.name for r in sink.products(spark).collect()}
    assert got["u1"] == "new" and got[other] == "newer" and len(got) == 26


def test_replies_by_row_and_once(spark, tmp_path):
    place, calls = str(tmp_path / "memo"), str(tmp_path / "calls")

    def model(texts):
        with open(calls, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [f"<{t}>" if t != "bad" or len(texts) > 9 else 1 / 0 for t in texts]

    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("bad",)], "color string").coalesce(1)
    asked = {r.color: (r.reply, r.error) for r in records.complete(rows.filter("color is not null"), model, "color").collect()}
    assert asked["a"] == ("<a>", None) and asked["bad"][0] is None and "ZeroDivisionError" in asked["bad"][1]
    os.remove(calls)
    for _ in range(2):
        got = sorted((r.color or "", r.reply or "") for r in records.remembered(rows, "color", place, model).collect())
    assert got == [("", ""), ("a", "<a>"), ("a", "<a>"), ("b", "<b>"), ("bad", "")]
    seen = open(calls).read().split()
    assert seen.count("bad") >= 2 and seen.count("a") <= 2  # the failed one again; a batch that fails asks each once more
    before = len(seen)
    records.remembered(rows.filter("color <> 'bad'"), "color", place, model).collect()
    assert len(open(calls).read().split()) == before
