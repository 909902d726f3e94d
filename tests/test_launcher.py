"""Launched batches: the stream with timers gives what the batch gives, whatever the order of arrival."""

import random

from pyspark.sql import functions as F

from quern.streaming import launcher

EVENTS = "run string, ts timestamp, seq long, kind string, url string, ok boolean, error string"


def at(spark, rows):
    raw = spark.createDataFrame(rows, "run string, ms long, seq long, kind string, url string, ok boolean, error string")
    return raw.select("run", F.timestamp_millis("ms").alias("ts"), "seq", "kind", "url", "ok", "error")


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def log(rng, runs=6, urls=23):
    rows = []
    for run in range(runs):
        for i in range(urls):
            rows.append((f"r{run}", 0, i, "queue", f"u{i}", None, None))
            t = i * 4000 + rng.randrange(0, 120_000)
            if rng.random() < 0.7:
                rows += [(f"r{run}", t + 7 * i, 100 + i, "result", f"u{i}", rng.random() < 0.8, "oops")] * rng.choice([1, 1, 2])
            if rng.random() < 0.4:
                rows.append((f"r{run}", t + rng.randrange(-9000, 2000) + 120_000, 200 + i, "closed", f"u{i}", None, None))
        rows.append((f"r{run}", 1, 99, "start", None, None, None))
        rows.append((f"r{run}", 2, 99, "dance", None, None, None))
    return rows


def test_rules_of_one_run(spark):
    rows = [("a", 0, i, "queue", u, None, None) for i, u in enumerate("pqrs")] + [("a", 10, 9, "start", None, None, None)]
    rows += [("a", 1000, 0, "closed", "p", None, None), ("a", 6000, 0, "result", "p", True, None)]  # exactly at the grace: in time
    rows += [("a", 2000, 0, "closed", "q", None, None), ("a", 7001, 0, "result", "q", True, None)]  # one late: failed, then a stray
    rows += [("a", 8000, 0, "result", "r", False, None), ("a", 9000, 0, "result", "p", True, None)]  # s opens at 8000; p again is no stray
    rows += [("b", 0, 0, "queue", "x", None, None)]  # never started
    got = told(launcher.outcomes(at(spark, rows), size=3))
    assert got == sorted([("a", "p", "done", None, 6000), ("a", "q", "failed", "closed before reporting", 7000), ("a", "q", "stray", None, 7001), ("a", "r", "failed", "error", 8000), ("a", "s", "failed", "batch timeout", 98_000)], key=str)
    assert launcher.outcomes(at(spark, [])).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Events arrive late, out of order and in pieces; a last one far ahead moves the watermark past all time-outs."""
    rng = random.Random(2)
    rows = [(r[0], r[1] + 1_700_000_000_000, *r[2:]) for r in log(rng)]  # a watermark begins at 1970
    want = told(launcher.outcomes(at(spark, rows)))
    assert {o[2] for o in want} == {"done", "failed", "stray"} and {o[3] for o in want} > {"batch timeout", "closed before reporting"}
    shaken = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 30_000))
    parts = [shaken[i : i + 120] for i in range(0, len(shaken), 120)] + [[("end", 1_700_010_000_000, 0, "start", None, None, None)], [("end", 1_700_020_000_000, 0, "start", None, None, None)]]
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in parts:
            at(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = launcher.launched(stream, "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "kept")).trigger(availableNow=True).start()
            assert query.awaitTermination(240) and query.exception() is None  # each part is a new start from the state that was kept
        assert told(spark.read.parquet(str(tmp_path / "out"))) == want
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
