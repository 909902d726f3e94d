"""Hard-negative mining: for an anchor and each of its positives, the best rows of other labels whose score lies in a window below the positive's.

Inner products become distances: with M the largest norm of a shard, every row gets one component more, sqrt(M^2 - |x|^2), so that all
rows have norm M and |q - x|^2 = |q|^2 + M^2 - 2 q.x. A window of scores is then an annulus around the anchor. Each shard of rows (a few
thousand, one row of the index table) is a vantage-point tree over the augmented vectors: a node keeps the vector it splits by and the
least and greatest distance from it in either half, so the triangle inequality bounds the scores below it. Leaves are opened nearest first;
those off the annulus are passed over, and the search ends once k rows are at least as near as anything unopened.
A task carries the k best of each window from one shard to its next, so later shards open less. Bounds are floats and only select
leaves (with a margin for rounding); scores are exact integers, and nothing is approximate: every row is in one tree, and results equal brute force.

The anchors are a stated query set. They are taken in batches of about `anchors` rows, broadcast in turn; of a batch the driver
sees its vectors and its positives (k rows each), and the shuffles k rows for each window and task. All rows, whatever their label, are dealt
evenly over the shards, so a common label or vector weighs on no task.

Rows with a null label, a null vector or a null or non-finite component take no part. Rows that are equal in id, label and vector count once; another row
is one of another id; a null id comes last among ties and is never an anchor's. A shorter vector is as if filled up with zeros. A score that doesn't fit a long fails the job
rather than wrap. An empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table, work_place

K, SHARD, LEAF, ANCHORS = 5, 4096, 256, 8192
#: Share of the positive's score, in hundredths, that a negative has at least and at most.
LEAST, MOST = 80, 100
_EXACT = 2.0**53


def clean(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, vector (doubles) of the rows that take part, each once."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf")))
    fit = rows.filter(F.col(label_col).isNotNull() & vector.isNotNull() & ~bad)
    return fit.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector")).distinct()


def matrix(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of vectors as rows, filled up with zeros to the longest."""
    vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(np.asarray(vectors.offsets))
    values = np.floor(256 * np.asarray(vectors.flatten(), dtype=np.float64))
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


class Tree:
    """A vantage-point tree over the rows of a shard, flat: rows by leaf, and for each leaf its ancestors with the least and greatest distance from each."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        norms = np.einsum("ij,ij->i", x, x)
        self.m2 = float(norms.max(initial=0.0))
        y = np.column_stack([x, np.sqrt(np.maximum(self.m2 - norms, 0))])
        points, paths, rows, ends = [], [], [], []

        def split(at, path):
            if len(at) <= leaf:
                rows.append(at)
                ends.append(len(at))
                paths.append(path)
                return
            here = y[at]
            centre = here.mean(axis=0)
            far = here[np.argmax(((here - centre) ** 2).sum(axis=1))]
            r = np.sqrt(((here - far) ** 2).sum(axis=1))
            half = len(at) // 2
            order = np.argpartition(r, half)  # halves whatever the ties
            points.append(far)
            n = len(points) - 1
            for part in (order[:half], order[half:]):
                split(at[part], [*path, (n, float(r[part].min()), float(r[part].max()))])

        split(np.arange(len(x)), [])
        self.rows = np.concatenate(rows)
        self.edge = np.concatenate([[0], np.cumsum(ends)])
        self.points = np.array(points).reshape(len(points), y.shape[1])
        depth = max(len(p) for p in paths)
        filled = [[*p, *[(-1, 0.0, math.inf)] * (depth - len(p))] for p in paths]
        self.node = np.array([[n for n, _, _ in p] for p in filled], dtype=np.int64).reshape(len(paths), depth)
        self.low = np.array([[a for _, a, _ in p] for p in filled]).reshape(len(paths), depth)
        self.high = np.array([[b for _, _, b in p] for p in filled]).reshape(len(paths), depth)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest and least score that each leaf can hold, for each anchor."""
        norms, width = np.einsum("ij,ij->i", q, q), min(q.shape[1], self.points.shape[1] - 1)
        both = norms[:, None] + self.m2
        apart = np.sqrt(np.maximum(both - 2 * (q[:, :width] @ self.points[:, :width].T), 0))
        near, far = np.zeros((len(q), len(self.node))), np.full((len(q), len(self.node)), math.inf)
        for i in range(self.node.shape[1]):
            known = self.node[:, i] >= 0
            d = apart[:, self.node[known, i]]
            near[:, known] = np.maximum(near[:, known], np.maximum(d - self.high[known, i], self.low[known, i] - d))
            far[:, known] = np.minimum(far[:, known], d + self.high[known, i])
        margin = 1 + 1e-7 * both
        return (both - near**2) / 2 + margin, (both - far**2) / 2 - margin


class Shard:
    """A tree with its rows in the order of the leaves."""

    def __init__(self, ids: pa.Array, labels: np.ndarray, x: np.ndarray, tree: Tree):
        self.tree, self.x, self.labels = tree, x[tree.rows], labels[tree.rows]
        self.unnamed = np.asarray(ids.is_null())[tree.rows]
        self.ids = np.asarray(ids.fill_null(0))[tree.rows]
        self.largest = float(np.abs(self.x).max(initial=0.0))

    def opened(self, leaf: int, q: np.ndarray, wanted: np.ndarray, floor: np.ndarray, ceiling: np.ndarray) -> list[list]:
        """For each anchor the rows of a leaf that it wants, as (-score, id is null, id), best first; scores are exact integers from floor to ceiling."""
        first, last = self.tree.edge[leaf], self.tree.edge[leaf + 1]
        width = min(q.shape[1], self.x.shape[1])
        rows, q = self.x[first:last, :width], q[:, :width]
        if self.largest * float(np.abs(q).max(initial=0.0)) * max(1, width) < _EXACT:
            scores = q @ rows.T
        else:
            whole = np.frompyfunc(int, 1, 1)
            scores = whole(q) @ whole(rows).T if width else np.zeros((len(q), last - first), dtype=object)
        anchor, at = np.nonzero(wanted & (scores >= floor[:, None]).astype(bool) & (scores <= ceiling[:, None]).astype(bool))
        found = [[] for _ in q]
        rows = zip(anchor.tolist(), scores[anchor, at].tolist(), self.unnamed[first + at].tolist(), self.ids[first + at].tolist(), strict=True)
        for n, score, unnamed, i in rows:
            found[n].append((-int(score), unnamed, i))
        for rows in found:
            rows.sort()
        return found

    def search(self, q: np.ndarray, windows: list[list], wanted, best: dict, k: int, step: int = 512) -> None:
        """Bring best[anchor, place], the k best (-score, id is null, id) so far, up to date with this shard.

        windows: of each anchor its (place, low, high). wanted(anchors, leaf): which rows of a leaf each of a slice of anchors may take.
        Each anchor opens its leaves nearest first; a leaf is scored once for the anchors of a block, by a product of matrices.
        """
        for start in range(0, len(q), step):
            part = slice(start, min(len(q), start + step))
            top, bottom = self.tree.bounds(q[part])
            order, top, bottom = np.argsort(-top, axis=1, kind="stable").tolist(), top.tolist(), bottom.tolist()
            ceiling = np.array([max((high for _, _, high in asked), default=-math.inf) for asked in windows[part]])
            leaves = {}
            for i, asked in enumerate(windows[part]):
                held = [(low, high, best.setdefault((start + i, place), [])) for place, low, high in asked]
                for leaf in order[i]:
                    # windows that this leaf, and so every later one, is too far for are done
                    held = [h for h in held if (reach := min(top[i][leaf], h[1])) >= h[0] and (len(h[2]) < k or reach >= -h[2][-1][0])]
                    if not held:
                        break
                    if all(bottom[i][leaf] > high for _, high, _ in held):
                        continue
                    if leaf not in leaves:
                        floor = [min((max(low, -b[-1][0]) if len(b := best.get((start + j, place), ())) == k else low for place, low, _ in each), default=math.inf) for j, each in enumerate(windows[part])]
                        leaves[leaf] = self.opened(leaf, q[part], wanted(part, leaf), np.array(floor), ceiling)
                    for row in leaves[leaf][i]:
                        for low, high, rows in held:
                            if low <= -row[0] <= high and (len(rows) < k or row < rows[-1]):
                                rows.append(row)
                                rows.sort()
                                del rows[k:]


INDEX = "ids array<long>, labels array<long>, width int, vectors binary"


def index(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """Shards of the rows, each one row of a table; trees are built where they are read, which takes less than writing them."""
    n = rows.count()

    def pack(batches):
        held = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not held:
            return
        all_rows = pa.concat_tables(held).combine_chunks()
        for i in range(0, all_rows.num_rows, shard):
            part = all_rows.slice(i, shard)
            x = matrix(part.column(2))
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["ids", "labels", "width", "vectors"])

    return cut(rows.repartition(max(1, math.ceil(n / shard))).mapInArrow(pack, INDEX))


def _shards(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column(0)[i].values, np.asarray(batch.column(1)[i].values)
            x = np.frombuffer(batch.column(3)[i].as_py(), dtype=np.float64).reshape(len(labels), batch.column(2)[i].as_py())
            yield Shard(ids, labels, x, Tree(x))


POSITIVES = "anchor long, score long, id long"
NEGATIVES = "anchor long, place long, score long, id long"


def _columns(rows, names):
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _positives(batch, k):
    """The k best rows of the anchors' labels among the shards of a task."""

    def run(batches):
        ids, labels, q = batch.value
        best, windows = {}, [[(0, -math.inf, math.inf)]] * len(ids)
        for shard in _shards(batches):

            def wanted(part, leaf, shard=shard):
                at = slice(shard.tree.edge[leaf], shard.tree.edge[leaf + 1])
                return (labels[part, None] == shard.labels[at]) & ((ids[part, None] != shard.ids[at]) | shard.unnamed[at])

            shard.search(q, windows, wanted, best, k)
        yield _columns([(n, -s, None if unnamed else i) for (n, _), rows in best.items() for s, unnamed, i in rows], ["anchor", "score", "id"])

    return run


def _negatives(batch, asked, k):
    """The k best rows of other labels in each window (place, low, high) of an anchor among the shards of a task."""

    def run(batches):
        (_, labels, q), best = batch.value, {}
        windows = [asked.value.get(n, []) for n in range(len(q))]
        for shard in _shards(batches):
            shard.search(q, windows, lambda part, leaf, shard=shard: labels[part, None] != shard.labels[shard.tree.edge[leaf] : shard.tree.edge[leaf + 1]], best, k)
        yield _columns([(n, place, -s, None if unnamed else i) for (n, place), rows in best.items() for s, unnamed, i in rows], ["anchor", "place", "score", "id"])

    return run


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows with rank, the k best of each group."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, k: int = K, shard: int = SHARD, batch_rows: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; both tables have id, label, vector as `clean` gives them."""
    spark = rows.sparkSession
    trees = index(rows, shard)
    batches = max(1, math.ceil(anchors.count() / batch_rows))
    place = work_place(spark, "hard-negatives")
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], empty).write.parquet(place)
    for b in range(batches):
        here = anchors.filter(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(batches)) == b).toArrow()
        if not here.num_rows:
            continue
        ids, labels = np.asarray(here.column(0)), np.asarray(here.column(1))
        batch = spark.sparkContext.broadcast((ids, labels, matrix(here.column(2))))
        positives = _first(trees.mapInArrow(_positives(batch, k), POSITIVES), ["anchor"], k).collect()
        asked = {}
        for p in positives:
            low, high = -(-LEAST * p.score // 100), MOST * p.score // 100
            if low <= high:
                asked.setdefault(p.anchor, []).append((p.rank, low, high))
        windows = spark.sparkContext.broadcast(asked)
        found = _first(trees.mapInArrow(_negatives(batch, windows, k), NEGATIVES), ["anchor", "place"], k)
        named = spark.createDataFrame([(p.anchor, p.rank, int(ids[p.anchor]), p.id, p.score) for p in positives], "anchor long, place long, anchor_id long, positive_id long, positive_score long")
        told = found.join(F.broadcast(named), ["anchor", "place"])  # k rows for each anchor of the batch
        told.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(place)
        batch.unpersist()
        windows.unpersist()
    return spark.read.schema(empty).parquet(place)


def op12_hard_negatives(spark, sf_dir):
    given = clean(table(spark, sf_dir, "embeddings"))
    rows = cut(given.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))
    return mine(rows, rows.filter("id % 100 = 0"))


SQL = r"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score FROM v AS a, v WHERE a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5
"""
