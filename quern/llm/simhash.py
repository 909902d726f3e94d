"""SimHash near-dedup by pigeonhole blocks.

A text is lower-cased (A-Z), cut into words and `shingle`-word shingles, repeats
included (fewer words: the whole sequence). Fingerprint bit i is 1 if it is set
in over half of the shingles' XXH64 values (seed 42); no words: fingerprint zero,
which links like any other. Null text counts as empty.

Links join distinct fingerprints, so copies never multiply. The 64 bits are cut
into blocks; two fingerprints at most `bits` apart agree on all but `bits` of
the blocks, so each choice of the others is a key, pairs meet on keys, and the
Hamming distance is verified. A key with more than `crowd` fingerprints would
give all pairs of a crowd; its members meet another way, equally exact: two
values are at most 2 apart just when their balls of radius 1 meet, so
each member sends itself and its 64 one-bit neighbours, and a meeting point has
at most 65 members. Components come from min-label star contraction on the links.
Rows with a null id get a fingerprint and their group's component, but name none. A very long text is
fingerprinted whole, 65,536 shingles at a time. Repeated rows share all they get. Columns named like the work columns
don't clash: near_groups reads id and text alone, and drop_near_copies carries each row as one struct. An empty table stays empty.

With `jaccard` (the pipeline's stage) texts whose sets of five-word shingles have a similarity of
4/5 or more are linked too. That join is exact: a set with a partner shares all but a fifth of its
shingles, which is told by a third of them first and by all of them for the sets that are left;
two partners then meet on one of the rarest fifth of each. A pair that meets is
compared only if sizes, the shingles that follow and 256 parities of each set leave it a chance; all such pairs are verified. On a shingle all sets meet
four of them first; only those that these stars leave in different components meet one another.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ascii_lower, cut, mix, slices, table

BLOCKS, CROWD, WIDE, SAMPLE, HEAD, PARITIES = 5, 64, 5, 3, 16, ("s1", "s2", "s3", "s4")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(line, 42)], dtype=np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        end = np.cumsum(size) - 1
        start = (end - size + 1)[: len(words) - shingle + 1].tolist()
        hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(start, end[shingle - 1 :].tolist(), strict=True)], np.uint64, len(start))
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64()), batch.column(2)], ["id", "fp", "text_key"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return given.mapInArrow(run, "id long, fp long, text_key long")


def links(distinct: DataFrame, bits: int, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b), a > b: all links of a table of distinct fingerprints `fp`, or, in crowds, links that connect the same ones."""
    if not 0 <= bits <= 2:
        raise ValueError("bits: 0, 1 or 2")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    mask = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    keys = []
    for n, same in enumerate(combinations(range(blocks), blocks - bits)):
        m = sum(mask[i] for i in same)
        m = m - (1 << 64) if m >= 1 << 63 else m
        keys.append(F.struct(F.lit(n).cast("byte").alias("n"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")))
    keyed = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.n", "key.part")
    group = keyed.groupBy("n", "part").agg(F.count("*").alias("size")).filter("size > 1")
    small, large = group.filter(F.col("size") <= crowd), group.filter(F.col("size") > crowd)
    met = keyed.join(small, ["n", "part"]).groupBy("n", "part").agg(F.collect_list("fp").alias("group"))
    pairs = met.select(F.explode("group").alias("a"), "group").select("a", F.explode("group").alias("b"))
    near = pairs.filter((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    crowded = keyed.join(large, ["n", "part"]).select("fp").distinct()
    if bits == 0:
        return near.distinct()
    one = [(1 << i) - (1 << 64 if i == 63 else 0) for i in range(64)]
    ball = crowded.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(v).cast("long") for v in one])).alias("flip"))
    meeting = ball.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    if bits == 1:  # the middle itself must be a member
        star = meeting.join(crowded.withColumnRenamed("fp", "middle"), "middle").select(F.greatest("fp", "middle").alias("a"), F.least("fp", "middle").alias("b"))
    else:
        lowest = meeting.groupBy("middle").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("group")).filter(F.size("group") > 1)
        star = lowest.select(F.explode("group").alias("a"), "b")
    return near.union(star.filter("a > b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node each node of (a, b) reaches, by alternating star contraction.

    Every round gives each node's neighbours to the node's smallest neighbour:
    the larger ones first, then the smaller ones. It ends when a round changes
    nothing; each round is written to the shared folder, so no lineage grows and a lost executor
    costs one round.
    """

    def star(now, larger):
        both = now if not larger else now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        told = both.join(least, "a")
        if larger:  # neighbours above the node
            return told.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return told.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a > b").distinct()

    def mark(now):
        return tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut(edges.select("a", "b").distinct())
    last = mark(now)
    while last[0]:
        now = cut(star(star(now, True), False))
        if (this := mark(now)) == last:
            break
        last, rounds = this, rounds - 1
        if not rounds:
            raise RuntimeError("components: no end in sight")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def gram_sets(texts: pa.Array, sample: int = 1):
    """key, n, grams and s1 to s4 of each text: a digest and the size of its set of five-word shingles, those with a hash divisible by `sample`, and 256 parities.

    Each shingle flips one of the 256 bits, so two sets differ in at least as many shingles as their bits differ.
    """
    for first, last in slices(texts):
        words = Words(texts.slice(first, last - first))
        gram, whole = words.grams(WIDE)
        row, gram = words.row[: len(gram)][whole], gram[whole]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        row, gram = row[new], gram[new]
        n = np.bincount(row, minlength=last - first)
        key = n.astype(np.uint64)
        np.add.at(key, row, mix(gram + np.uint64(1)))
        bits = np.zeros((len(PARITIES), last - first), dtype=np.uint64)
        np.bitwise_xor.at(bits, ((gram >> np.uint64(62)).astype(np.int64), row), np.uint64(1) << (gram >> np.uint64(56) & np.uint64(63)))
        taken = gram % np.uint64(sample) == 0
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[taken], minlength=last - first))])
        grams = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(gram[taken].view(np.int64)))
        yield first, last, pa.array(key.view(np.int64)), pa.array(n, pa.int64()), grams, *(pa.array(b.view(np.int64)) for b in bits)


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, fp, text_key of every row, with key, n and a sample of its set of five-word shingles."""

    def run(batches):
        for batch in batches:
            for a, b, key, n, grams, *_ in gram_sets(batch.column(2), SAMPLE):
                values = [fingerprint(t.as_py(), shingle) for t in batch.column(2).slice(a, b - a)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.int64()), part.column(1), key, n, grams], ["id", "fp", "text_key", "key", "n", "grams"])

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), ascii_lower(F.col(text_col)).alias("text"))
    return given.mapInArrow(run, "id long, fp long, text_key long, key long, n long, grams array<long>")


def shared_sets(docs: DataFrame, rows: DataFrame, text_col: str) -> DataFrame:
    """key, n, parities and the grams that other sets have too, rarest first, of every set that can have a partner."""
    slack = F.floor(F.col("n") / 5)  # of n shingles, all but so many are in a partner
    part = rows.filter("n > 0").withColumn("size", F.size("grams"))
    gram = part.select("key", "n", "size", F.explode("grams").alias("gram"))
    often = gram.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1").select("gram")
    met = gram.join(often, "gram").groupBy("key", "n", "size").agg(F.count("*").alias("met")).filter(F.col("met") >= F.col("size") - slack).select("key")
    left = met.union(part.filter(F.col("size") <= slack).select("key"))
    texts = cut(part.join(left, "key", "left_semi").select(F.col("text_key").alias("_key")).distinct())

    def run(batches):
        for batch in batches:
            for _, _, *columns in gram_sets(batch.column(0)):
                yield pa.RecordBatch.from_arrays(columns, ["key", "n", "grams", *PARITIES])

    given = docs.join(texts, F.xxhash64(text_col) == F.col("_key"), "left_semi").select(ascii_lower(F.col(text_col)).alias("text"))
    sets = cut(given.mapInArrow(run, "key long, n long, grams array<long>, s1 long, s2 long, s3 long, s4 long").dropDuplicates(["key"]))
    gram = sets.select("key", "n", *PARITIES, F.explode("grams").alias("gram"))
    often = gram.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    found = gram.join(often, "gram").groupBy("key", "n", *PARITIES).agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("grams"))
    return found.filter(F.size("grams") >= F.col("n") - slack).select("key", "n", *PARITIES, F.col("grams.gram").alias("grams"))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) of keys whose sets have a similarity of 4/5 or more."""
    one, other = (sets.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("grams").alias(f"g_{k}")) for k in "xy")
    met = pairs.join(one, "x").join(other, "y")
    return met.filter(9 * F.size(F.array_intersect("g_x", "g_y")) >= 4 * (F.col("n_x") + F.col("n_y"))).select("x", "y")


def jaccard_roots(docs: DataFrame, rows: DataFrame, near: DataFrame, text_col: str) -> DataFrame:
    """components of the links `near` of fingerprints and of all similar sets of five-word shingles."""
    sets = cut(shared_sets(docs, rows, text_col))
    names = cut(rows.join(sets, "key", "left_semi").select("key", "fp").distinct())
    name = cut(names.groupBy("key").agg(F.min("fp").alias("least")))
    copies = names.join(name, "key").filter("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))

    def named(pairs):
        x, y = name.select(F.col("key").alias("x"), F.col("least").alias("p")), name.select(F.col("key").alias("y"), F.col("least").alias("q"))
        met = pairs.join(x, "x").join(y, "y")
        return met.filter("p != q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b"))

    # the grams that no other set has are the rarest of all, so they fill the first places
    alone = F.col("n") - F.size("grams")
    first_places = F.slice("grams", 1, (F.floor(F.col("n") / 5) + 1 - alone).cast("int"))
    index = sets.select("key", "n", *PARITIES, alone.alias("alone"), F.posexplode(first_places).alias("i", "gram"))
    index = cut(index.select("key", "n", *PARITIES, (F.col("n") - F.col("alone") - F.col("i")).alias("rest"), "gram"))
    this = F.struct("key", "n", *PARITIES, "rest")
    chance = F.xxhash64("key")
    centers = F.array_distinct(F.array(F.min(this), F.max(this), F.min_by(this, chance), F.max_by(this, chance)))
    group = cut(index.groupBy("gram").agg(centers.alias("centers"), F.count("*").alias("size")).filter("size > 1"))

    def close(other):
        """What two similar sets fulfil on the first gram that they share: sizes, the grams from there on, parities."""
        both = F.col("n") + other["n"]
        differ = sum((F.bit_count(F.col(s).bitwiseXOR(other[s])) for s in PARITIES[1:]), F.bit_count(F.col("s1").bitwiseXOR(other["s1"])))
        return (5 * F.least(F.col("n"), other["n"]) >= 4 * F.greatest(F.col("n"), other["n"])) & (9 * F.least(F.col("rest"), other["rest"]) >= 4 * both) & (9 * differ <= both)

    def pair(other):
        return F.least("key", other["key"]).alias("x"), F.greatest("key", other["key"]).alias("y")

    center = F.col("center")
    met = index.join(group.select("gram", F.explode("centers").alias("center")), "gram")
    stars = met.filter((F.col("key") != center["key"]) & close(center)).select(*pair(center)).distinct()
    roots = cut(components(near.union(copies).union(named(alike(cut(stars), sets)))))

    root = name.join(roots.withColumnRenamed("node", "least"), "least", "left").select("key", F.coalesce("root", "least").alias("root"))
    # a pair meets on many grams; of those among the first HEAD of both, only the first counts
    root = root.join(sets.select("key", F.slice(first_places, 1, HEAD).alias("head")), "key")
    index = index.join(group.filter("size > 2").select("gram", F.col("centers.key").alias("done")), "gram").join(root, "key")
    parts = index.groupBy("gram", "root").agg(F.count("*").alias("size"))
    apart = parts.groupBy("gram").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    index = cut(index.join(apart, "gram").filter(~F.array_contains("done", F.col("key"))).drop("done"))
    its = F.col("its")
    others = index.select("gram", F.struct("key", "n", *PARITIES, "rest", "root", "head").alias("its"))
    unlike = (F.col("root") != its["root"]) & ((its["root"] == F.col("main")) | (F.col("key") < its["key"]))
    once = F.coalesce(F.get(F.array_intersect("head", its["head"]), F.lit(0)), F.col("gram")) == F.col("gram")
    left = index.filter("root != main").join(others, "gram").filter(unlike & close(its) & once).select(*pair(its)).distinct()
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a > b").union(named(alike(cut(left), sets))))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, jaccard: bool = False) -> DataFrame:
    """One row per input row: id, fp, text_key, component_id (smallest id of its group, itself included)."""
    rows = cut((described if jaccard else fingerprints)(docs, id_col, text_col, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    near = links(distinct, bits)
    roots = jaccard_roots(docs, rows, near, text_col) if jaccard else components(near)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    groups = named.join(least, "root").select("fp", "component_id")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "text_key", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, jaccard: bool = False) -> DataFrame:
    """The rows that stay, with all their columns: of each group the one with the smallest id.

    Rows with a null id stay; so do repeated rows of the id that stays.
    """
    groups = near_groups(docs, id_col, text_col, shingle, bits, jaccard)
    gone = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id"), "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"))
    return rows.join(gone, ["id", "text_key"], "left_anti").select("row.*")


def op10_simhash_near_dedup(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
