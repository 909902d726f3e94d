"""Scraped records: grouping variants, precedence, pruning, routing, grouped sources, rules in place of a model."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls


def group_variants(records: DataFrame) -> DataFrame:
    """place and url of each main record with its variants' urls; of variants without a main, the first becomes one.

    records: place, url, variant_of (a product key or null). Of mains with one key, the first gets the variants.
    """
    rows = records.withColumn("key", F.coalesce("variant_of", urls.product_key(F.col("url"))))
    main_first = Window.partitionBy("key").orderBy(F.col("variant_of").isNotNull(), "place")
    rows = rows.withColumn("n", F.row_number().over(main_first))
    is_main = F.col("variant_of").isNull() | (F.col("n") == 1)
    mains = rows.filter(is_main).select("key", "place", "url", (F.col("n") == 1).alias("first"))
    variants = rows.filter(~is_main).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "url"))).alias("v"))
    met = mains.join(variants, "key", "left")
    return met.select("place", "url", F.when(F.col("first") & F.col("v").isNotNull(), F.col("v.url")).otherwise(F.array().cast("array<string>")).alias("variants"))


def prefer(first: DataFrame, second: DataFrame, key: str, lists: list[str] = ()) -> DataFrame:
    """Field by field the first record's value, else the second's; a list counts only if it has items."""
    names = [c for c in first.columns if c != key]
    other = second.select(key, *[F.col(c).alias(f"_{c}") for c in names])

    def pick(c):
        return F.when(F.size(F.coalesce(F.col(c), F.array())) > 0, F.col(c)).otherwise(F.col(f"_{c}")) if c in lists else F.coalesce(F.nullif(F.col(c), F.lit("")) if dict(first.dtypes)[c] == "string" else F.col(c), F.col(f"_{c}"))

    return first.join(other, key, "left").select(key, *[pick(c).alias(c) for c in names])


def prune(products: DataFrame, removals: DataFrame) -> DataFrame:
    """products (url, files) without those whose url, or whose image files' folder, is to be removed (url, slug)."""
    left = products.join(removals.select("url").filter("url is not null").distinct(), "url", "left_anti")
    folders = left.select("url", F.explode(F.transform("files", lambda f: F.regexp_extract(f, "products/([^/]+)/", 1))).alias("slug")).filter("slug <> ''")
    hit = folders.join(removals.select("slug"), "slug", "left_semi").select("url").distinct()
    return left.join(hit, "url", "left_anti")


def missing_fields(description: Column, **fields: Column) -> Column:
    """Names of what a record lacks; a noisy description counts as lacking."""
    empty = [F.when(text.noisy_description(description), F.lit("description"))]
    empty += [F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "[]"), F.lit(name)) for name, c in fields.items()]
    return F.array_sort(F.array_compact(F.array(*empty)))


def rule_fields(x: Column) -> Column:
    """What the rules read from a product's text: the offline stand-in for a model."""
    return F.struct(text.wax_type(x).alias("wax_type"), text.vessel_material(x).alias("vessel_material"), text.burn_time_hours(x).alias("burn_time_hours"), text.scent_summary(x).alias("scent_summary"))


def derived_sources(targets: DataFrame) -> DataFrame:
    """field, parents (distinct, in order) and whether any is sure: targets has field, parent, value, confidence."""
    with_text = targets.filter(F.trim("value") != "")
    return with_text.groupBy("field").agg(F.array_sort(F.collect_set("parent")).alias("parents"), F.bool_or(F.col("confidence") == "also").alias("also"))


def complete(prompts: DataFrame, model, column: str = "prompt", out: str = "reply", error: str = "error") -> DataFrame:
    """prompts with a model's replies and, where there is none, the error: `model` takes a list of texts and gives as many.

    A batch is one call; where that fails, its prompts are asked once more, each alone, so a bad one costs only its own reply.
    """
    def ask(texts: list) -> list[dict]:
        try:
            replies = list(model(texts))
            if len(replies) != len(texts):
                raise ValueError(f"{len(replies)} replies to {len(texts)} prompts")
            return [{"reply": r, "error": None} for r in replies]
        except Exception as failed:  # noqa: BLE001  a model's failure is a row's error, not the job's
            return [{"reply": None, "error": f"{type(failed).__name__}: {failed}"}] * len(texts)

    def run(part: pd.Series) -> pd.DataFrame:
        texts = part.tolist()
        found = ask(texts)
        if found and found[0]["error"] is not None:
            found = [ask([t])[0] for t in texts]
        return pd.DataFrame(found, columns=["reply", "error"])

    answered = prompts.withColumn("_answer", F.pandas_udf(run, "reply string, error string")(F.col(column)))
    return answered.withColumns({out: F.col("_answer.reply"), error: F.col("_answer.error")}).drop("_answer")


def remembered(rows: DataFrame, column: str, place: str, model, out: str = "reply") -> DataFrame:
    """rows with the model's reply to each value of a column, from a table of replies at `place` that grows by what is new.

    Distinct values without a reply yet are asked, in batches, and written with reply or error before anything reads them, so a second run asks
    only for new values and those that failed. Nulls are never asked.
    """
    spark = rows.sparkSession
    schema = "value string, reply string, error string"
    try:
        known = spark.read.schema(schema).parquet(place).filter("error is null")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = spark.createDataFrame([], schema)
    asked = rows.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct().join(known, "value", "left_anti")
    complete(asked, model, "value").select("value", "reply", "error").write.mode("append").parquet(place)
    replies = spark.read.schema(schema).parquet(place).filter("error is null").groupBy("value").agg(F.min("reply").alias(out)).withColumnRenamed("value", "_value")
    return rows.join(replies, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")
