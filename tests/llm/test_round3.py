"""Quality votes, hard negatives and conversation repair against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import chat_repair, hard_negatives, quality_knn

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, copies long"


# conversation repair


def cheapest(rows):
    """(cost, audit, entries) of the best of all edits of rows (role, text, must go, truncated), two insertions at a place at most."""
    found = []

    def go(i, initials, cost, audit, out, inserted):
        if not re.fullmatch(r"(s?(ua)*u?)", initials):
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            found.append((cost, audit, out))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, initials + role[0], cost + 2, audit + "I", (*out, f"{role}:"), inserted + 1)
        if i == len(rows):
            return
        role, text, gone, truncated = rows[i]
        go(i + 1, initials, cost + 3, audit + "D", out, 0)
        if not gone:
            go(i + 1, initials + (role[:1] or "?"), cost + truncated, audit + "K", (*out, f"{role}:{text}"), 0)
            for who in ("user", "assistant"):
                go(i + 1, initials + who[0], cost + 2 + truncated, audit + "R", (*out, f"{who}:{text}"), 0)

    go(0, "", 0, "", (), 0)
    return min(found)


def told(rows):
    """What the contract says of one conversation's rows (turn, role, text), by brute force."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        end = text.rstrip(chat_repair.BLANKS)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = cheapest(judged)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repair_against_all_edits(spark):
    rng = random.Random(13)
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rng.randrange(1, 5)):
            text = rng.choice(["Yes.", "No", "", " \t\n", "Oh!", "so?", "x", "Zwölf "])
            rows += [(conv, rng.choice([None, 0, 1, 2, 7]), rng.choice(["user", "assistant", "system", "tool", "", "s", "User"]), text, rng.choice([1, 1, 2, 3]))]
    given = spark.createDataFrame(rows, TALK)
    got = {r[0]: tuple(r)[1:] for r in chat_repair.repaired(given, given.union(spark.createDataFrame([(999, None, None, None, 1)], TALK))).collect()}
    want = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        want[conv] += [(turn, role, text)] * copies
    assert got.pop(999) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {conv: told(r) for conv, r in want.items()}


def test_repair_across_segments(spark, monkeypatch):
    """Segments of three rows, and a row repeated over several of them, give what one scan gives."""
    rows = [(1, t, ["user", "assistant", "system"][t * t % 3], f"{t % 5}{'.' * (t % 2)}", 8 if t == 4 else 1) for t in range(40)]
    given = spark.createDataFrame(rows, TALK)
    whole = chat_repair.repaired(given, given).collect()
    monkeypatch.setattr(chat_repair, "SEGMENT", 3)
    assert chat_repair.repaired(given.repartition(7), given).collect() == whole
    placed = chat_repair._placed(given)  # and the scan of tasks equals the plain one
    symbols = b"".join(r[3] for batch in chat_repair._segments(placed.select("conv_id", "at", "turn", F.left("role", F.lit(1)), "fault", "fresh", "copies").orderBy("at").toArrow().to_batches()) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    assert (whole[0].cost, whole[0].audit) == chat_repair.repair(symbols)


def test_automaton_stays_small():
    """Lazy determinisation meets a handful of normalised vectors, however long the conversation."""
    rng, known = random.Random(1), chat_repair.Table()
    known.scan(bytes(rng.randrange(10) for _ in range(200_000)), known.of(chat_repair.FINAL)[0])
    assert len(known.vectors) < 64


def test_repair_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, at int, part string, kind string")
    assert chat_repair.repaired(chat_repair.damaged(empty), empty).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Ah. " * 100_000, 5, "x", "y")], empty.schema)
    assert chat_repair.repaired(chat_repair.damaged(rows), rows).count() == 1


def test_damage_of_nulls(spark):
    rows = spark.createDataFrame([(c, t, None, None) for c in (None, 1, 2, 3) for t in (None, 0, 1)], "conv_id long, turn long, role string, text string")
    kept = {(r.conv_id, r.turn): r for r in chat_repair.damaged(rows).collect()}
    for c in (None, 1, 2, 3):
        for t in (None, 0, 1):
            fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            assert ((c, t) in kept) == (fate != 0)
            if fate > 4:
                assert (kept[c, t].role, kept[c, t].text, kept[c, t].copies) == (" ", " ", 1)


# hard negatives

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows, anchors_every=100):
    """By brute force, with Python's integers."""
    held = {(i, (l + 1) % 10 if i is not None and i % 7 == 0 else l, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, l in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a in [h for h in held if h[0] is not None and h[0] % anchors_every == 0]:
        scored = sorted((-sum(x * y for x, y in zip(a[2], h[2], strict=False)), h[0] is None, h[0] or 0, h[1]) for h in held if h[0] != a[0])
        for p in [s for s in scored if s[3] == a[1]][:5]:
            fit = [s for s in scored if s[3] != a[1] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(a[0], None if p[1] else p[2], r, None if n[1] else n[2], -p[0], -n[0]) for r, n in enumerate(fit, 1)]
    return sorted(out, key=str)


def mine_rows(spark, rows, **kw):
    given = hard_negatives.clean(spark.createDataFrame(rows, VECTORS))
    fit = given.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return sorted(map(tuple, hard_negatives.mine(fit, fit.filter("id % 100 = 0"), **kw).collect()), key=str)


def test_mining_odd_rows(spark):
    rng = np.random.default_rng(12)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=rng.integers(1, 6)) + 0.6], int(rng.integers(0, 3))) for i in range(0, 600)]
    rows += rows[100:110]  # repeated rows
    rows += [(1000 + i, rows[200][1], i % 3) for i in range(80)]  # one vector many times: ties
    rows += [(None, rows[200][1], 1), (5000, None, 1), (5001, [float("nan")], 1), (5002, [None, 1.0], 1), (5003, [float("inf")], 2), (5004, [1.0], None), (5100, [], 0)]
    want = mined(rows)
    assert len(want) > 50
    assert mine_rows(spark, rows) == want
    assert mine_rows(spark, rows, shard=64, batch_rows=2) == want  # many shards a task, several batches of anchors


def test_mining_of_clusters_prunes(spark, monkeypatch):
    """In clustered data most leaves stay closed, and large components keep exact scores."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3e5
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=8) * 1e4], int(i // 12 % 3)) for i in range(3000)]
    opened, plain = [], hard_negatives.Shard.opened
    monkeypatch.setattr(hard_negatives.Shard, "opened", lambda self, leaf, *a: opened.append(leaf) or plain(self, leaf, *a))
    x = np.floor(256 * np.array([r[1] for r in rows]))
    import pyarrow as pa

    shard = hard_negatives.Shard(pa.array([r[0] for r in rows]), np.array([r[2] for r in rows]), x, hard_negatives.Tree(x, 32))
    best: dict = {}
    shard.search(x[:1], [[(0, -np.inf, np.inf)]], lambda part, leaf: shard.labels[None, shard.tree.edge[leaf] : shard.tree.edge[leaf + 1]] == 0, best, 5)
    assert len(opened) < len(shard.tree.node) / 3
    exact = sorted((-sum(int(a) * int(b) for a, b in zip(x[0], x[i], strict=True)), False, i) for i in range(3000) if rows[i][2] == 0)[:5]
    assert best[0, 0] == exact
    assert mine_rows(spark, rows) == mined(rows)


def test_mining_nothing(spark):
    assert mine_rows(spark, []) == []
    assert mine_rows(spark, [(1, [0.5], 0), (2, [0.25], 1)]) == []


# quality


def test_quality_on_held_out_labels(spark):
    scored = {r.doc_id: r for r in quality_knn.op11_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = dict(duckdb.connect().execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert len(scored) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    held = [(r.score, labels[i]) for i, r in scored.items() if r.held_out and i in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.95
    assert np.mean([g >= 0.3 for g in good]) > 0.98


def test_quality_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, id string, score string"
    texts = [None, "", " \n", "word", "Word! " * 50_000, "one two three.", "one two three."]
    docs = spark.createDataFrame([(i if i else None, t, None, None, "x", "y") for i, t in enumerate(texts)], schema)
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, 1), (None, 1), (6, None), (77, 1)], "doc_id long, quality int")
    model = quality_knn.fit(docs, labels)
    got = quality_knn.score(docs, model).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == 7 and by[None] == by[1] and by[5] == by[6] and by[5] > by[4]
    none = quality_knn.fit(docs, labels.filter("false"))
    assert {r.score for r in quality_knn.score(docs, none).collect()} == {0.5}
    assert quality_knn.score(docs.filter("false"), model).count() == 0


def test_quality_votes_against_plain_cosines():
    """Blocked products and merged copies give what a loop over all fitted rows gives."""
    rng = np.random.default_rng(3)
    import pyarrow as pa

    texts = [" ".join(rng.choice(["ab", "Cd.", "EF", "g7", "h!"], size=rng.integers(1, 30))) for _ in range(300)]
    counts, labels = quality_knn.terms(pa.array(texts)), rng.integers(0, 2, 300).astype(float)
    model = quality_knn.Model(counts[:200], labels[:200], axes=8)
    z = model.latent(quality_knn.weighted(counts, model.rarity))
    got = model.scores(counts[200:], k=200)
    for i, q in enumerate(z[200:]):
        weight = np.clip(z[:200] @ q, 0, 1).astype(float) ** quality_knn.SHARPNESS
        assert got[i] == pytest.approx((weight * labels[:200]).sum() / weight.sum(), abs=2e-3)
