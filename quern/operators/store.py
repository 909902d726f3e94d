"""Imports as one change set over a stored catalogue: products, their sizes and notes, and search documents, in folders by a hash of the slug.

An import is decided once (created, updated, skipped or failed, for every incoming row), kept as a table, and every stored table is derived
from it. Only the folders of changed products are written again, by dynamic partition overwrite; files elsewhere keep their names.
A product's rows share a bucket in every table, so each table is rewritten by a join within its touched folders and no
other is read. Broken off between two tables, the same import run again gives the same tables.

Incoming rows: place, slug, name, brand, description, notes (array of names), sizes (array of grams, price). A null field was not given and leaves what is stored (a sparse
patch); children that are given replace all that are stored. A row needs a name; a missing slug is made from it. Several rows of a slug count in the order of place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slugify
from .work import kept

FIELDS = ("name", "brand", "description", "notes", "sizes")
TABLES = {
    "products": "slug string, name string, brand string, description string, bucket int",
    "sizes": "slug string, position int, grams int, price long, is_primary boolean, bucket int",
    "notes": "slug string, position int, note string, bucket int",
    "documents": "slug string, text string, bucket int",
}


@dataclass
class Store:
    place: str
    buckets: int = 256

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        try:
            return spark.read.schema(TABLES[name]).parquet(f"{self.place}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], TABLES[name])

    def _bucket(self, slug):
        return F.pmod(F.xxhash64(slug), F.lit(self.buckets)).cast("int")

    def decide(self, incoming: DataFrame, update_existing: bool = True) -> DataFrame:
        """incoming with slug, status and error."""
        spark = incoming.sparkSession
        given = F.nullif(F.trim("slug"), F.lit(""))
        rows = incoming.withColumn("slug", F.coalesce(given, F.nullif(slugify(F.col("name")), F.lit(""))))
        error = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name: required").when(F.col("slug").isNull(), "slug: required")
        rows = rows.withColumn("error", error)
        stored = self.table(spark, "products").select("slug", F.lit(True).alias("stored"))
        nth = F.count_if(F.col("error").isNull()).over(Window.partitionBy("slug").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("nth", nth).join(stored, "slug", "left")
        there = F.col("stored").isNotNull() | (F.col("nth") > 1)
        status = F.when(F.col("error").isNotNull(), "failed").when(~there, "created").when(F.lit(update_existing), "updated").otherwise("skipped")
        return rows.withColumn("status", status).drop("nth", "stored")

    def load(self, incoming: DataFrame, update_existing: bool = True) -> DataFrame:
        """Write an import; place, slug, status, error of every incoming row."""
        spark = incoming.sparkSession
        decided = kept(self.decide(incoming, update_existing))
        taken = decided.filter("status in ('created', 'updated')")
        # what is given last of each field
        last = taken.groupBy("slug").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("place"))).alias(f) for f in FIELDS])
        changed = kept(last.withColumn("bucket", self._bucket(F.col("slug"))))
        touched = F.broadcast(changed.select("bucket").distinct())  # `buckets` numbers at most

        def held(name):
            return self.table(spark, name).join(touched, "bucket", "left_semi").select(*[f.split()[0] for f in TABLES[name].split(", ")])

        new = changed.select("slug", *[F.col(f).alias(f"_{f}") for f in FIELDS], F.col("bucket").alias("_bucket"))
        old = held("products")
        fields = ("name", "brand", "description")
        products = old.join(new, "slug", "full_outer").select("slug", *[F.coalesce(f"_{f}", f).alias(f) for f in fields], F.coalesce("bucket", "_bucket").alias("bucket"))
        sizes = changed.filter("sizes is not null").select("slug", F.posexplode("sizes").alias("position", "s"), "bucket").select("slug", "position", "s.grams", "s.price", (F.col("position") == 0).alias("is_primary"), "bucket")
        sizes = held("sizes").join(changed.filter("sizes is not null").select("slug"), "slug", "left_anti").select(sizes.columns).union(sizes)
        notes = changed.filter("notes is not null").select("slug", F.posexplode("notes").alias("position", "note"), "bucket")
        notes = held("notes").join(changed.filter("notes is not null").select("slug"), "slug", "left_anti").select(notes.columns).union(notes)
        products, notes = kept(products), kept(notes)
        # documents follow from what the tables will be, for changed products alone
        listed = notes.join(changed.select("slug"), "slug", "left_semi").groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "note"))), lambda n: n["note"]), " ").alias("listed"))
        text = F.concat_ws(" ", "name", "brand", "listed", "description")
        documents = products.join(changed.select("slug"), "slug", "left_semi").join(listed, "slug", "left").select("slug", text.alias("text"), "bucket")
        documents = held("documents").join(changed.select("slug"), "slug", "left_anti").select(documents.columns).union(documents)
        for name, rows in (("products", products), ("sizes", sizes), ("notes", notes), ("documents", documents)):
            columns = [f.split()[0] for f in TABLES[name].split(", ")]
            rows.select(columns).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.place}/{name}")
        return decided.select("place", "slug", "status", "error")
