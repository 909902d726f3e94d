"""A paged product catalogue as a Spark data source: one partition a page."""

from __future__ import annotations

import json
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages asked for at most, and products of a full page.
PAGES, PAGE_SIZE = 100, 250


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedCatalogue(DataSource):
    """Options: url (with {page}), pages, timeout. A page that fails gives one row with `error`; one without products gives none."""

    @classmethod
    def name(cls):
        return "paged_catalogue"

    def schema(self):
        return "page int, place int, handle string, product string, error string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.pages, self.timeout = options["url"], int(options.get("pages", PAGES)), float(options.get("timeout", 30))

    def partitions(self):
        return [_Page(n) for n in range(1, self.pages + 1)]

    def read(self, partition):
        n = partition.number
        try:
            with urlopen(self.url.replace("{page}", str(n)), timeout=self.timeout) as reply:  # noqa: S310  the url is the caller's
                products = json.load(reply).get("products") or []
        except (OSError, ValueError, AttributeError) as problem:
            yield n, None, None, None, f"{type(problem).__name__}: {problem}"
            return
        for place, product in enumerate(products):
            yield n, place, product.get("handle") or None, json.dumps(product), None


def read_catalogue(spark: SparkSession, url: str, pages: int = PAGES, page_size: int = PAGE_SIZE, most: int | None = None) -> DataFrame:
    """page, place, handle, product: each handle's first product, up to the first page that is short or failed.

    `most` is the caller's cap on products, in page order. Pages are read in parallel, so those behind a short page are asked for
    too and then left out.
    """
    spark.dataSource.register(PagedCatalogue)
    rows = spark.read.format("paged_catalogue").option("url", url).option("pages", pages).load()
    full = rows.groupBy("page").agg((F.count("product") >= page_size).alias("full"))
    known = spark.range(1, pages + 1).select(F.col("id").cast("int").alias("page")).join(full, "page", "left")
    end = known.filter("full is null or not full").agg(F.coalesce(F.min("page"), F.lit(pages)).alias("end"))
    taken = rows.join(F.broadcast(end), F.col("page") <= F.col("end")).filter("handle is not null")  # end is one row
    first = taken.groupBy("handle").agg(F.min(F.struct("page", "place", "product")).alias("p")).select("p.page", "p.place", "handle", "p.product")
    return first if most is None else first.orderBy("page", "place").limit(most)
