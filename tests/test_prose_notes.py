"""Notes and accords of descriptions against a plain reading of the rules."""

import random
import re

from pyspark.sql import functions as F

from quern.functions import prose


def plain(x):
    split = lambda s: [p.strip() for p in re.split(r",|\band\b", s)]
    line = re.search(r"tasting\s+notes\s*:\s*([^\n]+)", x, re.I)
    notes = [(n, "unknown") for n in split(line.group(1)) if len(n) > 2] if line else []
    if notes:
        return notes, []
    for label in prose.LISTS:
        chunk = re.search(rf"{label}\s*:?\s*(.+?)(?:\n[A-Z]|$)", x, re.I | re.S)
        if chunk:
            for name, stage in prose.STAGES:
                part = re.search(rf"{name}\s*:\s*([^.;]+)", chunk.group(1), re.I)
                notes += [(n, stage) for n in split(part.group(1)) if n] if part else []
            notes = notes or [(n, "unknown") for n in (re.sub(r"^[\d.]+\s*", "", p) for p in split(chunk.group(1))) if len(n) > 2]
            break
    accords = [a for a in prose.ACCORDS if a in x.lower()]
    family = re.search(r"olfactive\s+family:\s*([^\n.]+)", x, re.I)
    if family and family.group(1).strip() and family.group(1).strip().lower() not in accords:
        accords.insert(0, family.group(1).strip())
    return notes, accords


def test_notes_against_plain_rules(spark):
    rng = random.Random(9)
    words = ["Notes", "tasting notes", ":", "\n", "top:", "heart :", "BASE:", "rose", "fig and oak", ",", ".", ";", "1. ", "musk", "Olfactive family: ", "woody", "Fragrance notes", "and", "ab", " ", "Moss", "leather"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 18))) for _ in range(400)] + ["", "and", "notes"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", prose.notes_and_accords(F.col("t")).alias("f")).collect()
    for r in rows:
        assert ([tuple(n) for n in r.f.notes], r.f.accords) == plain(r.t), r.t
    none = spark.createDataFrame([(None,)], "t string").select(prose.notes_and_accords(F.col("t")).alias("f")).first().f
    assert none.notes == [] and none.accords == []


def test_texts_are_put_together_once(spark):
    assert str(prose.notes_and_accords(F.concat("a", "b"))).count("concat(a, b)") == 1
