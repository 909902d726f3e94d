"""Writes as table rewrites: patches, upserts, cascades, get-or-create, moderation, constraints; and child arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def patch(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the changed columns set; `has_x` tells whether x was given, so a given null sets null and an absent one leaves x.

    changes: one row a key.
    """
    names = [c for c in changes.columns if c != key and not c.startswith("has_")]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names], *[F.col(f"has_{c}").alias(f"_has_{c}") for c in names])
    met = rows.join(new, key, "left")
    return met.select(*[F.when(F.col(f"_has_{c}"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in rows.columns])


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Each (table, column) without the rows whose column is an id of `gone`."""
    return {name: rows.join(gone.select(F.col("id").alias(column)), column, "left_anti") for name, (rows, column) in tables.items()}


def split_ids(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each wanted id once, and whether there is a row of it."""
    known = rows.select(F.col(key).alias("id")).distinct().withColumn("_known", F.lit(True))
    return wanted.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("_known", F.lit(False)).alias("found"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """incoming replaces existing rows with equal keys; a null in a key equals nothing, so such rows are always added."""
    return existing.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def ensure(existing: DataFrame, wanted: DataFrame, key: str, fill: list[str]) -> DataFrame:
    """existing plus the wanted keys it lacks; `fill` columns are set together, and only where all of them are null. `created` tells new rows.

    Of several wanted rows of a key the smallest fill values count.
    """
    one = wanted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*fill)).alias("_new"))
    met = existing.withColumn("_old", F.lit(True)).join(one, key, "full_outer")
    empty = F.lit(True)
    for c in fill:
        empty = empty & F.col(c).isNull()
    rest = [c for c in existing.columns if c not in fill and c != key]
    return met.select(key, *rest, *[F.when(empty, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in fill], F.col("_old").isNull().alias("created"))


def moderate(reviews: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """reviews with the decided status; the first approval stamps published_at, later ones leave it."""
    met = reviews.join(decisions.select("review_id", F.col("status").alias("_status")), "review_id", "left")
    first = (F.col("_status") == "approved") & F.col("published_at").isNull()
    new = {"status": F.coalesce("_status", "status"), "published_at": F.when(first, now).otherwise(F.col("published_at"))}
    return met.select(*[new.get(c, F.col(c)).alias(c) for c in reviews.columns])


def repeated_keys(rows: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys that break a unique constraint (a partial one with `where`), with the number of rows."""
    rows = rows if where is None else rows.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows that break a foreign key; null refers to nothing and is allowed."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def zip_rows(**arrays: Column) -> Column:
    """Array of structs as long as the longest array; a shorter one gives its first element again, an empty one null."""
    n = F.greatest(*[F.size(F.coalesce(a, F.array())) for a in arrays.values()], F.lit(0))
    row = lambda i: F.struct(*[F.coalesce(F.get(a, i), F.get(a, F.lit(0))).alias(name) for name, a in arrays.items()])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), row)).otherwise(F.array())


def one_primary(items: Column) -> Column:
    """items (structs with is_primary) with one primary: the first that is flagged, else the first."""
    flags = F.transform(items, lambda x: F.coalesce(x["is_primary"], F.lit(False)))
    at = F.greatest(F.array_position(flags, True), F.lit(1)) - 1
    return F.transform(items, lambda x, i: x.withField("is_primary", i == at))


def placed(items: Column) -> Column:
    """items with their own position, or their index."""
    return F.transform(items, lambda x, i: x.withField("position", F.coalesce(x["position"], i)))
