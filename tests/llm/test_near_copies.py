"""Near copies of the pipeline's stage against all pairs of texts."""

import random

import corpus_pipeline
import pytest

from quern.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted(crowd):
    """Near copies with one to nine words changed, in chains and crowds; passages that many texts share; short and empty texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", "one two three four", "One two three FOUR", "one two three four five", "x one two three four five", " ".join(words[:5] * 40), " ".join(words[:5] * 30)]
    for size, copies in ((60, 4), (120, crowd), (300, 6)):
        base = rng.choices(words, k=size)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(1, 9) * size // 300 + 1):
                text[rng.randrange(size)] = rng.choice(words).upper()
            texts.append(" ".join(text))
        for step in range(8):  # a chain
            base[step * 6 % size] = rng.choice(words)
            texts.append(" ".join(base))
    lines = [" ".join(rng.choices(words, k=20)) for _ in range(6)]
    texts += ["\n".join(rng.sample(lines, rng.randint(1, 6))) for _ in range(60)]
    texts += [" ".join(rng.choices(words, k=90)) + " " + lines[0] for _ in range(40)]
    rng.shuffle(texts)
    return texts


def brute(texts, jaccard=True):
    """The smallest place that each text reaches over close fingerprints and similar sets."""
    fps = [simhash.fingerprint(t) for t in texts]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2 or jaccard and both and 5 * both >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("crowd", [12, 90])
def test_stage_equals_all_pairs(spark, crowd):
    texts = planted(crowd)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    want = brute(texts)
    assert len(set(want.values())) < len(set(brute(texts, jaccard=False).values()))
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs, jaccard=True).collect()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, None).collect()) == sorted(set(want.values()))


def test_stage_odd(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, None, None, 1), (1, text, None, None, 1), (None, text, None, None, 1), (2, text + " more", None, None, 1), (3, None, None, None, None), (None, None, None, None, None)]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, SCHEMA), None).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, text), (1, text), (1, text), (3, "")]
    assert corpus_pipeline.near(spark, spark.createDataFrame([], SCHEMA), None).count() == 0
