"""Extraction that can be resumed: a cascade of stages, errors as rows, and sinks that a rerun doesn't write to twice.

A record's fields are filled by stages in order, each only where those before left a field empty. A page that is a challenge, has no name
or makes its extraction fail becomes a row of the failures, beside the products of its batch.

`Sink.append` writes a batch into a folder of its own number, replacing what a broken try of the same batch left there, and leaves out keys that other batches
have; so after a stop anywhere, the same input gives the same table. `Sink.replace` extracts chosen keys anew: rows are kept by
a hash of their key in `buckets` folders, and only the folders of those keys are written again.

Null keys fail with a reason; of a key that comes twice in a batch the first in `order` stays; null texts are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a challenge page says, and how long a page with one of these may be.
CHALLENGES = ("just a moment", "challenges.cloudflare.com", "cf-browser-verification", "checking your browser", "access denied", "turnstile")
ALWAYS, SHORT = "just a moment", 5000
NO_NAME = "no product name extracted"


def blocked(html: Column, success: Column | None = None) -> Column:
    """Whether a fetched page is a challenge instead of what was asked for, or wasn't fetched at all."""
    low = F.lower(F.coalesce(html, F.lit("")))
    said = F.contains(low, F.lit(CHALLENGES[0]))
    for marker in CHALLENGES[1:]:
        said = said | F.contains(low, F.lit(marker))
    challenge = said & ((F.length(low) < SHORT) | F.contains(low, F.lit(ALWAYS)))
    return challenge if success is None else challenge | ~F.coalesce(success, F.lit(False))


def cascade(fields: dict[str, list[tuple[str, Column]]]) -> Column:
    """struct of the fields and `stages` (which stage gave each): of every field the first stage with a value; an empty text is none."""

    def filled(c):
        return c.isNotNull() & (c.cast("string") != "")

    values = [F.coalesce(*[F.when(filled(c), c) for _, c in stages]).alias(name) for name, stages in fields.items()]
    by = [F.coalesce(*[F.when(filled(c), F.lit(stage)) for stage, c in stages], F.lit("none")) for stages in fields.values()]
    pairs = [x for name, stage in zip(fields, by, strict=True) for x in (F.lit(name), stage)]
    return F.struct(*values, F.map_filter(F.create_map(*pairs), lambda _, stage: stage != "none").alias("stages"))


def extract(pages: DataFrame, key: Column, fields: dict[str, list[tuple[str, Column]]], needed: str = "name", html: str = "html", success: str | None = None) -> DataFrame:
    """key, url, record, error of every page; error is null for a product."""
    rows = pages.select(key.alias("key"), "url", cascade(fields).alias("record"), blocked(F.col(html), F.col(success) if success else None).alias("blocked"))
    error = F.when(F.col("key").isNull(), "no key").when(F.col("blocked"), "blocked").when(F.col(f"record.{needed}").isNull(), NO_NAME)
    return rows.select("key", "url", F.when(error.isNull(), F.col("record")).alias("record"), error.alias("error"))


@dataclass
class Sink:
    """Products and failures below one place of the shared store."""

    place: str
    buckets: int = 64

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{self.place}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def append(self, found: DataFrame, batch: int, order: Column | None = None) -> None:
        """The new products and the failures of a batch; once, however often it is tried."""
        spark = found.sparkSession
        first = Window.partitionBy("key").orderBy(order if order is not None else F.col("url"))
        products = found.filter("error is null").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "error")
        written = self._read(spark, "products")
        if written is not None:
            products = products.join(written.filter(F.col("batch") != batch).select("key"), "key", "left_anti")
        products = products.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)))
        products.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.place}/products/batch={batch}")
        found.filter("error is not null").select("key", "url", F.lit("extract").alias("stage"), F.col("error").alias("reason")).write.mode("overwrite").parquet(f"{self.place}/failures/batch={batch}")

    def products(self, spark: SparkSession) -> DataFrame:
        """key, url, record; after replacements the newer row of a key."""
        base, newer = self._read(spark, "products"), self._read(spark, "replaced")
        if base is None:
            raise ValueError(f"no products at {self.place} yet")
        kept = base.select("key", "url", "record")
        if newer is None:
            return kept
        # a replaced folder stands for its bucket
        return base.join(F.broadcast(newer.select("bucket").distinct()), "bucket", "left_anti").select("key", "url", "record").union(newer.select("key", "url", "record"))

    def failures(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "failures").select("key", "url", "stage", "reason")

    def replace(self, found: DataFrame) -> None:
        """Products of these keys anew; keys whose extraction fails keep what they had. Folders without such a key stay as they are."""
        spark = found.sparkSession
        fresh = found.filter("error is null").dropDuplicates(["key"]).select("key", "url", "record").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)))
        touched = F.broadcast(fresh.select("bucket").distinct())  # `buckets` numbers at most
        held = self.products(spark).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets))).join(touched, "bucket", "left_semi").select("key", "url", "record", "bucket")
        whole = held.join(fresh.select("key"), "key", "left_anti").select(fresh.columns).union(fresh)
        whole.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.place}/replaced")


def run(stream: DataFrame, sink: Sink, extracted, checkpoint: str):
    """A query that extracts every batch of a stream of pages into the sink; extracted: pages -> what `extract` gives."""
    return stream.writeStream.foreachBatch(lambda batch, n: sink.append(extracted(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
