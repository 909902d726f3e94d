"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but these six ASCII characters.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
_GAP = np.zeros(256, dtype=bool)
_GAP[list(WHITESPACE)] = True
#: Random odd 64-bit values, one for each byte and one for each place in a word, from a fixed seed, so that every worker hashes alike.
_BYTE, _PLACE = (np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed, size in ((20240117, 256), (20240118, 256)))
_LENGTH, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Text bytes that the hash kernels hold at once; a longer text is taken alone.
KERNEL_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only where there is none and all runs on this machine, as in tests."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named := tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return named


def work_place(spark: SparkSession, name: str = "") -> str:
    """A new place for a work table of this application, below quern-work/<application id>."""
    return f"{shared_folder(spark)}/quern-work/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}{name and '-' + name}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the folder that all executors share: no lineage, and sizes that the planner knows."""
    place = work_place(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def clear_work(spark: SparkSession, application: str | None = None) -> bool:
    """Remove the work tables of an application (this one by default), once its results are written; whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quern-work/{application or spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ordered(rows: DataFrame, order: list, sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with _place (0, 1, ... in `order` over all rows) and, for each of `sums`, its total in the rows before, _before_<name>.

    Ranges of the order are written as a table; each range counts for itself and adds what the ranges before
    it hold, so no task sees all rows. `order` should tell rows apart.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    held = parts.groupBy("_part").agg(F.count("*").alias("_rows"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    before = [F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_earlier_{c}") for c in sums]
    held = held.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_from"), *before)
    line = Window.partitionBy("_part").orderBy(*order)
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    here = parts.select("*", F.row_number().over(line).alias("_n"), *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"_past_{c}") for c in sums])
    found = here.join(F.broadcast(held), "_part")
    return found.select(*rows.columns, (F.col("_n") - 1 + F.col("_from")).alias("_place"), *[(F.col(f"_past_{c}") + F.col(f"_earlier_{c}")).alias(f"_before_{c}") for c in sums])


def ascii_lower(text):
    """A-Z lowered and nothing else; null as empty. Pure ASCII text takes the fast built-in."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def mix(h: np.ndarray) -> np.ndarray:
    """Spread each 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def slices(column: pa.Array):
    """Runs of rows (first, after last) whose texts have at most KERNEL_BYTES together, or one row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    first = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total + n > KERNEL_BYTES and i > first:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


class Words:
    """The words of some texts as arrays: start, end (byte offsets), row, hash (64 bits).

    A word's hash is a sum of random products, one for each byte and place (XXH64 for words over 256 bytes); it
    selects candidates. Where equality decides, compare the bytes or a digest of them.
    """

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "").cast(pa.large_utf8())
        column = pa.concat_arrays([column])
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        base = int(offsets[0])
        self.data = np.frombuffer(buffer, dtype=np.uint8)[base : int(offsets[-1])] if buffer is not None else np.zeros(0, np.uint8)
        offsets = offsets - base
        self.offsets, n = offsets, len(self.data)
        solid = ~_GAP[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~solid[:-1]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        after = np.ones(n, dtype=bool)
        after[:-1] = ~solid[1:]
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        if len(self.start):
            length = self.end - self.start
            place = np.arange(n, dtype=np.int64)
            place -= np.repeat(self.start, np.diff(np.append(self.start, n))) if self.start[0] == 0 else np.concatenate([np.zeros(self.start[0], np.int64), np.repeat(self.start, np.diff(np.append(self.start, n)))])
            part = _BYTE[self.data]
            part[~solid] = 0
            part *= _PLACE[np.minimum(place, len(_PLACE) - 1)]
            self.hash = mix(np.add.reduceat(part, self.start) + length.astype(np.uint64) * _LENGTH)
            for i in np.flatnonzero(length > len(_PLACE)).tolist():
                self.hash[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes(), 42)
        else:
            self.hash = np.zeros(0, dtype=np.uint64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they are all of one text."""
        size = max(0, len(self.hash) - n + 1)
        h = np.zeros(size, dtype=np.uint64)
        for i in range(n if size else 0):
            h = h * _GRAM + self.hash[i : i + size]
        return mix(h), self.row[:size] == self.row[n - 1 : n - 1 + size] if size else np.zeros(0, dtype=bool)


    def line(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, with the start and the end of each."""
        length = self.end - self.start
        inside = np.repeat(np.arange(len(length)), length)
        out = np.full(len(inside) + len(length), 32, dtype=np.uint8)
        out[np.arange(len(inside)) + inside] = self.data[~_GAP[self.data]]
        start = np.cumsum(length) - length + np.arange(len(length))
        return out.tobytes(), start, start + length


def heavy_keys(keys: DataFrame, k: int = 1024, least: int = 32, rows_of=iter) -> list[int]:
    """Misra-Gries over a bigint column, the first of what `rows_of` makes of the batches of `keys`: all keys with over 1/k of all rows, and none with under 3/(4k) or `least`.

    Each partition keeps 4k counters; a batch's counts are added and, where more
    than 4k stay above zero, the (4k+1)th largest is taken from all. Sums of the partitions'
    counters fall short by 1/(4k) of all rows at most, so 3/(4k) tells. Nulls don't count.
    The driver gets 4k/3 numbers at most, whatever the input.
    """
    size = 4 * k

    def summaries(batches):
        held, count, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in rows_of(batches):
            key, n = np.unique(np.asarray(batch.column(0).drop_null()), return_counts=True)
            rows += int(n.sum())
            both, where = np.unique(np.concatenate([held, key]), return_inverse=True)
            count = np.bincount(where, weights=np.concatenate([count, n]), minlength=len(both)).astype(np.int64)
            if len(both) > size:
                count -= np.partition(count, len(count) - size - 1)[len(count) - size - 1]
            held, count = both[count > 0], count[count > 0]
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.int64()), pa.array([*count, rows], pa.int64())], ["key", "n"])

    found = keys.mapInArrow(summaries, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    # the null row has the number of all rows, and so comes first
    top = found.orderBy(F.desc("n"), F.col("key").asc_nulls_first()).limit(size // 3 + 2).collect()
    total = next((r.n for r in top if r.key is None), 0)
    return [r.key for r in top if r.key is not None and r.n * size >= 3 * total]
