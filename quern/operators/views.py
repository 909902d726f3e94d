"""Product views: nested notes and accords, sizes and images in order, ratings, search documents, child replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers

#: Note stages in display order, and what the middle is called otherwise.
STAGES = ("top", "middle", "base", "general")
STAGE_OF = {"heart": "middle", "head": "top"}


def ordered_children(rows: DataFrame, parent: str, order: list, fields: list, name: str) -> DataFrame:
    """One row a parent: its children as an array of `fields`, sorted by the `order` columns (nulls first); one partial aggregate, no fan-out."""
    key = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    item = F.struct(key.alias("k"), F.struct(*fields).alias("v"))
    return rows.groupBy(parent).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))


def accord_bars(accords: Column) -> Column:
    """An array of accords (name, pct), the strongest first, null as -1; equal ones keep their order."""
    marked = F.transform(accords, lambda x, i: F.struct((-F.coalesce(x["pct"], F.lit(-1))).alias("d"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(marked), lambda m: m["x"])


def top(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def stage_name(stage: Column) -> Column:
    """The stage a note is shown under: null as general, unknown ones as Notes."""
    s = F.lower(F.coalesce(stage, F.lit("general")))
    for other, known in STAGE_OF.items():
        s = F.when(s == other, known).otherwise(s)
    return F.when(s.isin(*STAGES), s).otherwise("Notes")


def notes_by_stage(notes: DataFrame, parent: str = "product_id") -> DataFrame:
    """parent, place, stage, notes: stages in fixed order, "Notes" last, notes by position (null as 0) and name."""
    shown = stage_name(F.col("stage"))
    rows = notes.select(parent, shown.alias("stage"), F.coalesce("position", F.lit(0)).alias("position"), "note")
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    rows = rows.withColumn("place", F.when(place == 0, len(STAGES) + 1).otherwise(place).cast("int"))
    return rows.groupBy(parent, "place", "stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "note"))), lambda x: x["note"]).alias("notes"))


def rating_view(products: DataFrame, reviews: DataFrame, summaries: DataFrame) -> DataFrame:
    """products with rating and rating_count: the mean of approved reviews, else the stored summary."""
    own = reviews.filter("status = 'approved'").groupBy("product_id").agg(F.avg("stars").alias("_avg"), F.count("*").alias("_n"))
    met = products.join(own, "product_id", "left").join(summaries.select("product_id", F.col("rating_avg").alias("_s"), F.col("rating_count").alias("_sn")), "product_id", "left")
    return met.select(*products.columns, F.coalesce("_avg", "_s").alias("rating"), F.coalesce("_n", "_sn", F.lit(0)).alias("rating_count"))


def words_of(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """key and its distinct values, commas as blanks, sorted and joined by one blank."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.replace(value, F.lit(","), F.lit(" ")))), " ").alias(name))


def search_documents(products: DataFrame, notes: DataFrame, accords: DataFrame, reviews: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """product_id, name, brand, notes, accords, reviews: one document a product, children aggregated before the joins.

    Reviews are the approved ones, 200 characters of each. `only` (product_id) rebuilds these alone, as after a
    rename or a moderation.
    """
    if only is not None:
        products, notes, accords, reviews = (t.join(only.select("product_id").distinct(), "product_id", "left_semi") for t in (products, notes, accords, reviews))
    parts = (
        words_of(notes, "product_id", F.col("note"), "notes"), words_of(accords, "product_id", F.col("accord"), "accords"),
        words_of(reviews.filter("status = 'approved'"), "product_id", F.left("body", F.lit(200)), "reviews"),
    )
    found = products.select("product_id", "name", "brand")
    for part in parts:
        found = found.join(part, "product_id", "left")
    return found.select("product_id", "name", "brand", *[F.coalesce(c, F.lit("")).alias(c) for c in ("notes", "accords", "reviews")])


def replace_documents(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with fresh documents in the place of those of the same product."""
    return index.join(fresh.select("product_id"), "product_id", "left_anti").unionByName(fresh)


def replace_children(old: DataFrame, new: DataFrame, parent: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows after, keys removed): a parent that has new children loses its old ones; removed are the keys that don't come back."""
    touched = new.select(parent).distinct()
    removed = old.join(touched, parent, "left_semi").join(new.select(parent, key), [parent, key], "left_anti").select(parent, key)
    return old.join(touched, parent, "left_anti").unionByName(new), removed


def first_per_key(rows: DataFrame, keys: list, order: str) -> DataFrame:
    """The first row of each key in order; the rest is dropped."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fill_first_primary(rows: DataFrame, parent: str, order: str, target: str, value: str) -> DataFrame:
    """`target` of the first primary row (or the first row) of each parent takes `value` where it is null."""
    w = Window.partitionBy(parent).orderBy(F.desc("is_primary"), order)
    filled = F.when(F.row_number().over(w) == 1, F.coalesce(target, value)).otherwise(F.col(target))
    return rows.withColumn(target, filled)


def collapse_lines(text: Column, chars: int) -> Column:
    """Lines trimmed, blank ones and those equal to the one before dropped, cut to `chars` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    paired = F.arrays_zip(lines.alias("a"), F.concat(F.array(F.lit("")), lines).alias("b"))
    kept = F.filter(paired, lambda p: p["a"].isNotNull() & ~p["a"].eqNullSafe(p["b"]))
    return F.left(F.array_join(F.transform(kept, lambda p: p["a"]), "\n"), F.lit(chars))


def public_image(key: Column, is_primary: Column, base: str) -> Column:
    return F.struct(F.concat(F.lit(base.rstrip("/") + "/"), key).alias("url"), (is_primary == 1).alias("is_primary"))


def rounded(x: Column) -> Column:
    """Halves up, as imports do."""
    return numbers.round_half_up(x)


def flagged(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with flags, the names of the rules that hold, in order."""
    return rows.withColumn("flags", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def stage_seconds(timings: DataFrame) -> DataFrame:
    """name, seconds: the sum of every *_seconds entry of a map column `timing` (thousandths)."""
    entry = timings.select(F.explode("timing").alias("name", "value")).filter(F.col("name").endswith("_seconds"))
    return entry.groupBy("name").agg(F.round(F.sum("value"), 3).alias("seconds"))


def best_links(links: DataFrame, limit: int | None = None) -> DataFrame:
    """url and its best score, best first; a limit is the feature of the top list."""
    best = links.groupBy("url").agg(F.max("score").alias("score"))
    return best if limit is None else best.orderBy(F.desc("score"), "url").limit(limit)


def newest(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key in order: profiles of the newest reviews, tails of logs."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def status_profile(rows: DataFrame, key: str, statuses: list[str]) -> DataFrame:
    """key, one count for each status (zeroes too) and the total."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return rows.groupBy(key).agg(*counts, F.count("*").alias("total"))


def paired_by_place(left: DataFrame, right: DataFrame, key: str, left_order: list, right_order: list) -> DataFrame:
    """Rows of both sides with the same place within a key, each side in its own order; the longer side's rest is left out."""
    def placed(rows, order):
        return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))

    return placed(left, left_order).join(placed(right, right_order), [key, "_place"]).drop("_place")


def nth_of_type(nodes: DataFrame) -> DataFrame:
    """nodes (page, parent, tag, ord) with nth, the rank among siblings of the same tag."""
    return nodes.withColumn("nth", F.row_number().over(Window.partitionBy("page", "parent", "tag").orderBy("ord")))


def named_or_raw(rows: DataFrame, raw: DataFrame, word: str) -> DataFrame:
    """Keys of rows whose name or url has the word in any case; those of raw rows where no row has it."""
    def having(t):
        return t.filter(F.lower("name").contains(word.lower()) | F.lower("url").contains(word.lower())).select("key").distinct()

    found = having(rows)
    some = found.limit(1).select(F.lit(True).alias("_some"))
    return found.union(having(raw).join(F.broadcast(some), F.lit(True), "left_anti"))


def resolve(wanted: DataFrame, options: DataFrame, keys: list[str], value: str) -> DataFrame:
    """wanted with `value` of the option that its keys name, and error where there is none."""
    met = wanted.join(options.select(*keys, value), keys, "left")
    return met.withColumn("error", F.when(F.col(value).isNull(), F.concat(F.lit("unknown option: "), F.concat_ws("/", *keys))))


def guarded_update(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` changed where a change differs from what is there, and whether it did; null never differs, as in SQL."""
    met = rows.join(changes.select(key, F.col(column).alias("_new")), key, "left")
    differs = F.coalesce(F.col(column) != F.col("_new"), F.lit(False))
    return met.select(*[F.when(differs, F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in rows.columns], differs.alias("changed"))


def techniques(candidates: list[DataFrame], most: int) -> DataFrame:
    """url and the first technique (0, 1, ...) that found it; later techniques count only while those before found fewer than `most`."""
    found = None
    for i, urls in enumerate(candidates):
        mine = urls.select("url").distinct().withColumn("technique", F.lit(i))
        found = mine if found is None else found.unionByName(mine.join(found.select("url"), "url", "left_anti"))
        if found.limit(most).count() >= most:
            break
    return found
