"""Mixing sources to target weights by Sainte-Lague apportionment.

A document's size is its number of words. Sources in code point order (null
last) have the weights 5, 2, 1, 5, ... and share `share` percent of all sizes; a target
stops at twice its source's size and the rest is shared again by weight. All targets are cut
into blocks of equal tokens, and Sainte-Lague's highest quotients target / (2k - 1)
give every source its number of them. The token
line of each source is dealt over shards (by id) and cut into runs of so many blocks that a large
source has no short snippets because of a small one (a run has a 256th of the source's target at most, and 4,096
words at most); Sainte-Lague gives every shard its quota of runs, and in
a shard the runs with the lowest seeded digests are taken, twice at most. So no
document exceeds twice its size, and a rerun takes the same words. A source's words differ from its
target by rounding to runs and by the short last run of each shard.

Null text has size 0; such rows are returned with taken 0. Null ids are dealt by a
hash of their text. Repeated rows are separate documents, also where they agree in id and text and lie in different sources.
A very long text spans many runs; its words are found once for each row of the mix it is in. Columns named like the work
columns don't clash: mix reads id, text and source alone, and take carries each row as one struct. An empty table gives an
empty table. Source totals are one row per source, stay in DataFrames, and are ranked by ranges; the driver gets their sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, ordered, table

SHARE, SHARD_WORDS, BLOCK_MIN, BLOCK_MAX, SEED = 150, 2_000_000, 16, 4096, 7
#: Weights by place in the order of sources.
WEIGHTS = (5, 2, 1)


def _length(target):
    """Words of a block for a target: a 256th of it, within bounds."""
    return F.greatest(F.lit(BLOCK_MIN), F.least(F.lit(BLOCK_MAX), F.coalesce(F.floor(target / 256), F.lit(BLOCK_MIN)))).cast("long")


def targets(sizes: DataFrame, share: int = SHARE) -> DataFrame:
    """source, source_size, target, place, block (tokens, the same for all) and per (blocks of a run) of a table with `source` and `size`."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = ordered(s, [F.col("source").asc_nulls_last()]).withColumnRenamed("_place", "place")
    s = s.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), F.col("place") % len(WEIGHTS))).withColumn("cap", 2 * F.col("source_size"))
    # sources fill up in the order of size per weight; the first that need not stop at its cap gives the level of all after it
    s = cut(ordered(s, [F.col("source_size") / F.col("weight"), F.col("place")], ("cap", "weight")))
    total, weights = s.agg(F.sum("source_size"), F.sum("weight")).first()
    left, free = F.lit(share * (total or 0)).cast("long") - 100 * F.col("_before_cap"), F.lit(weights or 0).cast("long") - F.col("_before_weight")
    fits = left * F.col("weight") <= 200 * F.col("source_size") * free
    level = s.filter(fits).agg(F.min(F.struct("_place", left.alias("left"), free.alias("free"))).alias("x")).select("x.*").first()
    target = F.col("cap").cast("double")
    if level["_place"] is not None:
        target = F.when(F.col("_place") < level["_place"], target).otherwise((F.lit(level["left"]).cast("long") * F.col("weight")).cast("double") / F.lit(100 * level["free"]))
    s = s.withColumn("target", target)
    least = s.agg(F.min(F.when(F.col("target") > 0, F.col("target")))).first()[0]
    s = s.withColumn("block", _length(F.lit(least).cast("double")))
    return s.select("source", "source_size", "target", "place", "block", F.floor(_length(F.col("target")) / F.col("block")).alias("per"))


def _quotients(parties: DataFrame, votes: str, all_votes, n, seats) -> DataFrame:
    """parties with the seats they get at least (_low) and at most (_high).

    With n parties, votes / seats moved by n / 2 seats bounds the final divisor from both sides:
    rounding by the upper bound gives at most all seats, by the lower one at least all, so only quotients
    in between are ranked, about n of them.
    """
    share = F.col(votes) / all_votes
    low, high = F.floor(share * F.greatest(F.lit(0.0), seats - n / 2) + 0.4999999), F.floor(share * (seats + n / 2) + 0.5000001) + 1
    p = parties.withColumn("_low", F.when(all_votes > 0, low).otherwise(0)).withColumn("_high", F.when(all_votes > 0, high).otherwise(0))
    return p.withColumn("_quotients", F.when((F.col(votes) > 0) & (F.col("_high") > F.col("_low")), F.sequence(F.col("_low") + 1, F.col("_high"))))


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: str) -> DataFrame:
    """parties with `quota`: Sainte-Lague seats within each group; ties go to the lower `order`."""
    whole = Window.partitionBy(*group)
    p = parties.withColumn("_n", F.count("*").over(whole)).withColumn("_votes", F.sum(votes).over(whole))
    p = _quotients(p, votes, F.col("_votes"), F.col("_n"), F.col(seats)).withColumn("_rest", F.col(seats) - F.sum("_low").over(whole))
    k = p.select(*group, order, votes, "_rest", F.explode("_quotients").alias("k"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("k") - 1)), order)
    more = k.withColumn("_r", F.row_number().over(best)).filter("_r <= _rest").groupBy(*group, order).agg(F.count("*").alias("_more"))
    p = p.join(more, [*group, order], "left")
    return p.withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_n", "_votes", "_low", "_high", "_quotients", "_rest", "_more")


def apportion_all(parties: DataFrame, votes: str, seats: int, order: str) -> DataFrame:
    """parties with `quota`: Sainte-Lague seats over the whole table, quotients ranked by ranges."""
    n, total = parties.agg(F.count("*"), F.sum(votes)).first()
    p = _quotients(parties, votes, F.lit(total or 0), F.lit(n).cast("long"), F.lit(seats).cast("long"))
    rest = seats - (p.agg(F.sum("_low")).first()[0] or 0)
    k = p.select(order, votes, F.explode("_quotients").alias("k"))
    k = ordered(k, [F.desc(F.col(votes) / (2 * F.col("k") - 1)), F.col(order)])
    more = k.filter(F.col("_place") < rest).groupBy(order).agg(F.count("*").alias("_more"))
    return p.join(more, order, "left").withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_low", "_high", "_quotients", "_more")


def dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: int, shard_words: int) -> DataFrame:
    """id, text_key, source, size, source_size, target, place, block (words of a run), source_blocks (its quota of runs) and shard of every row."""
    sized = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    sized = cut(sized)
    source = cut(targets(sized, share))
    wanted, block = source.agg(F.sum("target"), F.max("block")).first()
    source = apportion_all(source, "target", int((wanted or 0.0) / (block or 1) + 0.5), "place")
    runs = F.floor((2 * F.col("quota") + F.col("per")) / (2 * F.col("per")))
    shards = F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words).cast("long")
    source = source.select(F.col("source").alias("of"), "source_size", "target", "place", (F.col("block") * F.col("per")).alias("block"), runs.alias("source_blocks"), shards.alias("shards"))
    rows = sized.join(cut(source), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return rows.withColumn("shard", F.pmod(F.coalesce(F.col("id").cast("long"), "text_key"), "shards"))


def pieces(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """What is taken of dealt rows with words: id, text_key, source, copy, copies, size, source_size, target and of each run met: first word, words, times (null: not taken).

    copy numbers the `copies` rows that agree in source, id and text.
    """
    rows = rows.filter("size > 0")
    shard = rows.groupBy("place", "shard", "block", "source_blocks").agg(F.sum("size").alias("words"))
    shard = apportion(shard, ["place"], "words", "source_blocks", "shard")
    shard = shard.withColumn("n", F.ceil(F.col("words") / F.col("block")).cast("long"))
    shard = shard.withColumn("quota", F.least("quota", 2 * F.col("n")))
    one = shard.select("place", "shard", "n", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("b"))
    drawn = F.row_number().over(Window.partitionBy("place", "shard").orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "place", "shard", "b"), 256), "b"))
    one = one.withColumn("times", F.floor(F.col("quota") / F.col("n")) + F.when(drawn <= F.col("quota") % F.col("n"), 1).otherwise(0)).filter("times > 0").select("place", "shard", "b", "times")

    line = Window.partitionBy("place", "shard").orderBy("id", "text_key")
    same = Window.partitionBy("place", "shard", "id", "text_key")
    rows = rows.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("copy", F.row_number().over(same.orderBy(F.lit(0)))).withColumn("copies", F.count("*").over(same))
    start = F.col("end") - F.col("size")
    span = F.sequence(F.floor(start / F.col("block")), F.floor((F.col("end") - 1) / F.col("block")))
    met = rows.select("*", F.explode(span).alias("b")).join(one, ["place", "shard", "b"], "left")
    first = F.greatest(start, F.col("b") * F.col("block"))
    words = F.least("end", (F.col("b") + 1) * F.col("block")) - first
    return met.select("id", "text_key", "source", "copy", "copies", "size", "source_size", "target", "b", (first - start).alias("first"), words.alias("words"), "times")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: int = SHARE, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken."""
    rows = dealt(docs, id_col, text_col, source_col, share, shard_words)
    taken = F.sum(F.coalesce(F.col("words") * F.col("times"), F.lit(0))).cast("long")
    found = pieces(rows, seed).groupBy("id", "text_key", "source", "copy", "size", "source_size", "target").agg(taken.alias("taken"))
    every = found.select("id", "size", "source_size", "target", "taken").union(rows.filter("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long")))
    return every.withColumnRenamed("id", id_col)


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: int = SHARE, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with docs' columns: up to two rows a document.

    A pass that takes all of a document has its text unchanged; else the passages it takes, each as it stands
    in the text (whitespace at its ends aside), joined by a newline.
    """
    keys = ["id", "text_key", "source"]
    drawn = pieces(dealt(docs, id_col, text_col, source_col, share, shard_words), seed).filter("times > 0")
    drawn = drawn.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).repartition(*keys)
    # neighbouring runs make one passage
    drawn = drawn.withColumn("passage", F.col("b") - F.row_number().over(Window.partitionBy(*keys, "copy", "turn").orderBy("b")))
    passage = drawn.groupBy(*keys, "copies", "copy", "turn", "size", "passage").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    turns = passage.groupBy(*keys, "copies", "copy", "turn", "size").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("passages"), F.sum("words").alias("taken"))
    draw = F.struct("copy", (F.col("taken") == F.col("size")).alias("whole"), "passages")
    turns = turns.groupBy(*keys, "copies").agg(F.collect_list(draw).alias("draws")).withColumnsRenamed({k: f"_{k}" for k in keys})

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"))
    met = rows.join(turns, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_text_key")) & F.col("source").eqNullSafe(F.col("_source")))
    single = met.filter("copies = 1").select("row", F.explode("draws").alias("draw"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    several = met.filter("copies > 1").withColumn("number", number).select("row", F.explode(F.filter("draws", lambda d: d["copy"] == F.col("number"))).alias("draw"))
    words = F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    # the generator's output keeps the words from being found again for every passage
    cutting = single.union(several).select("row", "draw", F.explode(F.array(F.when(~F.col("draw.whole"), words))).alias("words"))
    passages = F.transform("draw.passages", lambda p: F.btrim(F.array_join(F.slice("words", (p["first"] + 1).cast("int"), p["words"].cast("int")), ""), F.lit(" \t\n\x0b\x0c\r")))
    text = F.when(F.col("draw.whole"), F.col(f"row.{text_col}")).otherwise(F.array_join(passages, "\n"))
    done = cutting.select("row", text.alias("text"))
    new = {text_col: F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


#: The same rules said plainly: all quotients are listed and ranked. For tables of the size of sf0.01.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s0),
s2 AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s1),
s3 AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, place) AS rank, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
  coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  coalesce(sum(weight) OVER (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM s2),
lv AS (SELECT min(rank) AS at_rank, arg_min(150 * total - 100 * capped, rank) AS rest, arg_min(weights - passed, rank) AS open FROM s3
  WHERE (150 * total - 100 * capped) * weight <= 200 * source_size * (weights - passed)),
s4 AS (SELECT source, source_size, place, CASE WHEN rank < at_rank THEN (2 * source_size)::DOUBLE ELSE (rest * weight)::DOUBLE / (100 * open)::DOUBLE END AS target FROM s3, lv),
u AS (SELECT *, greatest(16, least(4096, coalesce(floor((SELECT min(target) FROM s4 WHERE target > 0) / 256), 16)))::BIGINT AS unit FROM s4),
s5 AS (SELECT *, greatest(16, least(4096, coalesce(floor(target / 256), 16)))::BIGINT // unit AS per, unit * per AS block FROM u),
s6 AS (SELECT *, round((SELECT sum(target) FROM s4) / unit)::BIGINT AS seats, ceil(greatest(source_size, 1) / 2000000)::BIGINT AS shards FROM s5),
q1 AS (SELECT place, target, seats, unnest(range(1, seats + 1)) AS k FROM s6 WHERE target > 0),
q2 AS (SELECT place, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, place) AS r, seats FROM q1),
q3 AS (SELECT place, count(*) AS source_blocks FROM q2 WHERE r <= seats GROUP BY place),
r AS (SELECT d.doc_id, d.size, s6.source_size, s6.target, s6.place, s6.block, (2 * coalesce(q3.source_blocks, 0) + s6.per) // (2 * s6.per) AS source_blocks, d.doc_id % s6.shards AS shard
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN q3 ON q3.place = s6.place),
h1 AS (SELECT place, shard, block, source_blocks, sum(size)::BIGINT AS words FROM r GROUP BY ALL),
h2 AS (SELECT place, shard, words, source_blocks, unnest(range(1, source_blocks + 1)) AS k FROM h1 WHERE words > 0),
h3 AS (SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY words / (2 * k - 1) DESC, shard) AS r, source_blocks FROM h2),
h4 AS (SELECT place, shard, count(*) AS quota FROM h3 WHERE r <= source_blocks GROUP BY ALL),
h5 AS (SELECT h1.place, h1.shard, ceil(words / block)::BIGINT AS n, coalesce(quota, 0) AS quota FROM h1 LEFT JOIN h4 ON h1.place = h4.place AND h1.shard = h4.shard),
b1 AS (SELECT place, shard, n, least(quota, 2 * n) AS quota, unnest(range(0, n)) AS b FROM h5),
b2 AS (SELECT *, row_number() OVER (PARTITION BY place, shard ORDER BY sha256('7|' || place || '|' || shard || '|' || b), b) AS drawn FROM b1),
b3 AS (SELECT place, shard, b, quota // n + CASE WHEN drawn <= quota % n THEN 1 ELSE 0 END AS times FROM b2),
e1 AS (SELECT *, sum(size) OVER (PARTITION BY place, shard ORDER BY doc_id)::BIGINT AS stop FROM r),
e2 AS (SELECT *, stop - size AS start, unnest(range((stop - size) // block, (stop - 1) // block + 1)) AS b FROM e1 WHERE size > 0),
t AS (SELECT e2.doc_id, sum((least(stop, (e2.b + 1) * block) - greatest(start, e2.b * block)) * times)::BIGINT AS taken
  FROM e2 JOIN b3 ON e2.place = b3.place AND e2.shard = b3.shard AND e2.b = b3.b GROUP BY e2.doc_id)
SELECT r.doc_id, r.size, r.source_size, r.target, coalesce(t.taken, 0)::BIGINT AS taken FROM r LEFT JOIN t ON r.doc_id = t.doc_id
"""
