"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text becomes four blocks of term counts: its words, the shapes of its words (letters, capitals, digits, signs, what it begins and
ends with, rough length), pairs of neighbouring shapes, and how much of it repeats (a word equal to the one before or to any
earlier one, words on a line, words in all), each hashed into a fixed number of places. Counts enter as 1 + log n, are
weighted by how rare a term is among the fitted texts, and each block is brought to a fixed length, so a long text counts like a
short one. The fitted texts' covariance gives the latent axes (its largest eigenvectors); every text is projected on them.

`fit` takes at most `most` labelled rows (the least hashes of their ids, so the choice is the same in every run); the model is those rows'
latent vectors with their labels, the axes and the weights, a few MB whatever the corpus, and is broadcast. `score` computes the cosine of every
document with every fitted vector, in blocks of rows, and lets the k nearest vote with weight (cosine)^8. Fitted texts with
equal vectors are one neighbour with their labels' mean and their number as weight, so copies neither crowd out others nor make ties.

Nothing but the text is an input of a score. A null text is as an empty one; an empty text has the terms "no words" and "no lines"
and is scored like any other. A text without labelled neighbours (no label at all was given) scores `prior`. Null labels and null ids are not learnt from; an id labelled twice
has the mean. Very long texts are read whole, alone in their slice; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, slices, table

#: Bounds of the fitted sample, and sizes of the blocks of terms.
MOST, AXES, NEIGHBOURS, SHARPNESS, BLOCK = 4096, 48, 25, 8, 256
PLACES = {"words": 512, "shapes": 512, "pairs": 512, "repeats": 64}
WEIGHTS = {"words": 0.4, "shapes": 1.0, "pairs": 1.0, "repeats": 1.0}
WIDTH = sum(PLACES.values())
#: Kinds of bytes: capital, other letter, digit, end of a sentence, other mark of prose, anything else.
_KINDS = np.full(256, 32, dtype=np.uint8)
_KINDS[ord("A") : ord("Z") + 1] = 1
_KINDS[ord("a") : ord("z") + 1] = _KINDS[128:] = 2
_KINDS[ord("0") : ord("9") + 1] = 4
_KINDS[list(b".!?")] = 8
_KINDS[list(b",;:'\"()-")] = 16


def _ratio(part, whole, steps=8):
    """A share as one of steps + 2 places; none and all have their own."""
    share = part / np.maximum(whole, 1)
    return np.where(part == 0, 0, np.where(part >= whole, steps + 1, 1 + np.floor(share * steps)).astype(np.int64))


def terms(column: pa.Array) -> np.ndarray:
    """Counts of terms (float32, rows x WIDTH) of some texts."""
    words, n = Words(column), len(column)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    per_row = np.bincount(words.row, minlength=n)
    lines = np.zeros(n, dtype=np.int64)
    row = words.row
    offset = dict(zip(PLACES, np.concatenate([[0], np.cumsum(list(PLACES.values()))]).tolist(), strict=False))

    def count(name, place, at, weight=None):
        size = PLACES[name]
        found = np.bincount(at * size + place, weights=weight, minlength=n * size)
        out[:, offset[name] : offset[name] + size] += found.reshape(n, size).astype(np.float32)

    again = before = np.zeros(0, dtype=bool)
    if len(row):
        count("words", (words.hash % np.uint64(PLACES["words"])).astype(np.int64), row)
        kinds = _KINDS[words.data]
        seen = np.bitwise_or.reduceat(np.where(_gaps(words), 0, kinds), words.start).astype(np.uint64)
        length = np.minimum(np.log2(words.end - words.start + 1).astype(np.uint64), np.uint64(5))
        first, last = kinds[words.start].astype(np.uint64), kinds[words.end - 1].astype(np.uint64)
        shape = ((seen * np.uint64(64) + first) * np.uint64(64) + last) * np.uint64(8) + length
        count("shapes", (mix(shape + np.uint64(1)) % np.uint64(PLACES["shapes"])).astype(np.int64), row)
        pair = mix(shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:] + np.uint64(1))
        inside = row[1:] == row[:-1]
        count("pairs", (pair[inside] % np.uint64(PLACES["pairs"])).astype(np.int64), row[1:][inside])
        before = np.concatenate([[False], inside & (words.hash[1:] == words.hash[:-1])])
        order = np.lexsort((words.hash, row))
        again = np.zeros(len(row), dtype=bool)
        again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (words.hash[order[1:]] == words.hash[order[:-1]])
        breaks = np.flatnonzero(words.data == 10)
        lines = np.bincount(np.searchsorted(words.offsets, breaks, side="right") - 1, minlength=n)[:n]
    each = np.arange(n)
    size = np.minimum(np.log2(per_row + 1).astype(np.int64), 15)
    count("repeats", size, each)  # 0 to 15; places below: shares
    count("repeats", 16 + _ratio(np.bincount(row[before], minlength=n) if len(row) else lines, per_row), each)
    count("repeats", 28 + _ratio(np.bincount(row[again], minlength=n) if len(row) else lines, per_row), each)
    count("repeats", 40 + np.minimum(np.log2(per_row / (lines + 1) + 1).astype(np.int64), 15), each)
    return out


def _gaps(words: Words) -> np.ndarray:
    """Which bytes are of no word."""
    change = np.zeros(len(words.data) + 1, dtype=np.int32)
    np.add.at(change, words.start, 1)
    np.add.at(change, words.end, -1)
    return np.cumsum(change[:-1]) == 0


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Counts as 1 + log n, times rarity; each block brought to its length."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * rarity
    at = 0
    for name, size in PLACES.items():
        part = x[:, at : at + size]
        part *= WEIGHTS[name] / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        at += size
    return x


class Model:
    """Rarity of terms, latent axes, and the fitted texts' unit vectors with label and number."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, axes: int = AXES):
        self.prior = float(labels.mean()) if len(labels) else 0.5
        held = (counts > 0).sum(axis=0)
        self.rarity = (np.log((1 + len(labels)) / (1 + held)) + 1).astype(np.float32)
        x = weighted(counts, self.rarity)
        if len(labels):
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            self.axes = vectors[:, np.argsort(-values)[:axes]].astype(np.float32)
        else:
            self.axes = np.zeros((WIDTH, axes), dtype=np.float32)
        # equal texts give equal rows up to rounding of the products
        points, where, number = np.unique(np.round(self.latent(x), 4), axis=0, return_inverse=True, return_counts=True)
        self.points, self.number = np.ascontiguousarray(points), number.astype(np.float32)
        self.labels = (np.bincount(where.reshape(-1), weights=labels) / np.maximum(number, 1)).astype(np.float32) if len(labels) else np.zeros(0, np.float32)

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The vote of each row's k nearest fitted vectors, by blocks of rows against all of them."""
        out = np.full(len(counts), self.prior)
        for a in range(0, len(counts), BLOCK if len(self.points) else len(counts) + 1):
            if not len(self.points):
                break
            cosine = self.latent(weighted(counts[a : a + BLOCK], self.rarity)) @ self.points.T
            k = min(k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, 1).astype(np.float64) ** SHARPNESS * self.number[near]
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
            out[a : a + BLOCK] = np.where(total > 1e-12, vote, self.prior)
        return np.round(np.clip(out, 0, 1), 4)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST) -> Model:
    """A model of at most `most` labelled rows; labels: id and label (0 to 1) of the rows to learn from."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id", F.lit(11)), "_id").limit(most)

    def counted(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                found = terms(batch.column(0)[a:b])
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in found], pa.binary()), batch.column(1)[a:b], batch.column(2)[a:b]], ["terms", "label", "id"])

    # `most` rows at the largest: broadcast to find their texts, and gathered as counts
    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("_id")).join(F.broadcast(chosen), "_id").select("text", F.col("_label"), "_id")
    once = texts.groupBy("_id").agg(F.min("text").alias("text"), F.min("_label").alias("label")).select("text", "label", "_id")
    found = once.mapInArrow(counted, "terms binary, label double, id long").orderBy("id").toArrow()
    counts = np.frombuffer(b"".join(v.as_py() for v in found.column(0)), dtype=np.float32).reshape(found.num_rows, WIDTH)
    return Model(counts, np.asarray(found.column(1), dtype=np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(shared.value.scores(terms(batch.column(1)[a:b])))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def held_out(doc_id):
    """Whether crc32 of the id, as text, is divisible by 5; a null id isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op11_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
