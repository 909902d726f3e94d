"""Substring dedup: words of repeated passages go, the first document keeps them.

Two forms share the word and window rules.

`remove_reference_spans` is the method named for this operator, for a reference set of fixed size: tasks build
suffix automata of its shards, these are broadcast, documents stream through them for matching
statistics, and maximal matches of at least `window` words are removed. Its work is shards x
documents, which is quadratic where the reference is the corpus itself.

`dedup_corpus` is for that case. A window (13 words in a row) goes when its words
also start in a document with a smaller id. Of the 8-word sequences of a window, the
one of least hash (the anchor) is the same wherever the window is found, so only windows
whose anchor lies in two documents can repeat: anchors are grouped first, then
the windows of shared anchors get their smallest document id, and each document
drops the words of windows that a smaller id has. Anchors with more than
1/`heavy` of all anchor rows (Misra-Gries) are taken as shared without a shuffle, so no group of a shuffle holds more than that share.
Of their windows, those that very many documents have (`heavy` windows at most) make the reference shard:
its suffix automaton, over word hashes, is broadcast with the smallest id of each window, and documents stream through it for matching statistics.
Hashes only select; whether two windows are the same is told by 96-bit BLAKE2b digests of their words, everywhere.

Rows with a null id are neither compared nor changed; rows that share an id count as one document; null text has no
words. A very long text is taken alone in its batch slice, whole; what a task holds is a few numbers for each of its bytes. Repeated
rows are equal documents. Extra columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, cut, heavy_keys, slices, table

WINDOW, ANCHOR, HEAVY = 13, 8, 16384


def anchors_of(words: Words, window: int, anchor: int):
    """For each window start: its anchor's hash, and whether the window lies in one text."""
    gram, _ = words.grams(anchor)
    size = max(0, len(words.hash) - window + 1)
    least = gram[:size].copy()
    for i in range(1, window - anchor + 1):
        np.minimum(least, gram[i : i + size], out=least)
    least >>= np.uint64(16)  # 48 bits select well enough, and are two bytes less to shuffle
    return least, words.row[:size] == words.row[window - 1 : window - 1 + size] if size else np.zeros(0, dtype=bool)


def _anchor_rows(window, anchor, skip):
    skip = np.array(sorted(skip), dtype=np.int64)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b in slices(batch.column(1)):
                words = Words(batch.column(1)[a:b])
                least, whole = anchors_of(words, window, anchor)
                at = np.flatnonzero(whole)
                if not len(at):
                    continue
                row, key = words.row[at], least[at].view(np.int64)
                new = np.ones(len(at), dtype=bool)  # windows in a row mostly share their anchor
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                if len(skip):
                    new &= ~np.isin(key, skip)
                yield pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(ids[a:b][row[new]])], ["key", "id"])

    return run


def _digests(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """BLAKE2b (96 bits, as a number of 64 and one of 32) of the words of the windows that begin at `at`."""
    line, start, end = words.line()
    parts = [blake2b(line[a:b], digest_size=12).digest() for a, b in zip(start[at].tolist(), end[at + window - 1].tolist(), strict=True)]
    digest = np.frombuffer(b"".join(parts), dtype=[("k1", "<i8"), ("k2", "<i4")])
    return np.column_stack([digest["k1"], digest["k2"].astype(np.int64)])


def _window_rows(window, anchor, hot, skip):
    """k1, k2, id, tag, pos of the windows whose anchor is hot or in the row's list."""
    hot = np.array(sorted(hot), dtype=np.int64)

    def run(batches):
        for batch in batches:
            ids, tags, shared = np.asarray(batch.column(0)), np.asarray(batch.column(2)), batch.column(3)
            for a, b in slices(batch.column(1)):
                words = Words(batch.column(1)[a:b])
                least, whole = anchors_of(words, window, anchor)
                at = np.flatnonzero(whole)
                key = least[at].view(np.int64)
                at = at[np.isin(key, hot) | _member(words.row[at], key, shared[a:b])]
                if not len(at):
                    continue
                digest = _digests(words, at, window)
                if skip:
                    new = np.array([d not in skip for d in zip(*digest.T.tolist(), strict=True)], dtype=bool)
                    at, digest = at[new], digest[new]
                row = words.row[at]
                pos = at - np.searchsorted(words.row, row)
                columns = [pa.array(digest[:, 0]), pa.array(digest[:, 1].astype(np.int32)), pa.array(ids[a:b][row]), pa.array(tags[a:b][row]), pa.array(pos.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "id", "tag", "pos"])

    return run


def _hot_rows(window, anchor, hot):
    """k1, k2, n, first_id, words (hashes) of the windows whose anchor is hot, summed for each slice."""
    hot = np.array(sorted(hot), dtype=np.int64)

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b in slices(batch.column(1)):
                words = Words(batch.column(1)[a:b])
                least, whole = anchors_of(words, window, anchor)
                at = np.flatnonzero(whole & np.isin(least.view(np.int64), hot))
                if not len(at):
                    continue
                # one row for each window of the slice: its rows, its smallest id, its words
                each, first, where, count = np.unique(_digests(words, at, window), axis=0, return_index=True, return_inverse=True, return_counts=True)
                least_id = np.full(len(each), np.iinfo(np.int64).max)
                np.minimum.at(least_id, where.reshape(-1), ids[a:b][words.row[at]])
                hashes = words.hash[at[first][:, None] + np.arange(window)].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * window), pa.array(hashes.reshape(-1)))
                columns = [pa.array(each[:, 0]), pa.array(each[:, 1]), pa.array(count.astype(np.int64)), pa.array(least_id), lists]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "n", "first_id", "words"])

    return run


def hot_windows(known: DataFrame, hot: list[int], window: int, anchor: int, k: int) -> list:
    """(k1, k2, first_id, words) of the windows in more than 1/k of the rows that hot anchors have; k at most.

    Summed before the shuffle; the driver gets k rows at most, each of `window` word hashes, a digest and an id.
    """
    if not hot:
        return []
    rows = known.select("id", "text").mapInArrow(_hot_rows(window, anchor, hot), "k1 long, k2 long, n long, first_id long, words array<long>")
    rows = cut(rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.min("words").alias("words")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    return rows.filter(F.col("n") * k > total).collect()


def _member(row, key, lists) -> np.ndarray:
    """Whether key[i] is in lists[row[i]]; row ascends."""
    found = np.zeros(len(row), dtype=bool)
    edge = np.searchsorted(row, np.arange(len(lists) + 1))
    for r in range(len(lists)):
        if edge[r] < edge[r + 1] and lists[r].is_valid:
            part = slice(edge[r], edge[r + 1])
            found[part] = np.isin(key[part], np.asarray(lists[r].values))
    return found


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n), -1)
    return np.cumsum(change[:n]) > 0


def matches(words: Words, automaton: SuffixAutomaton, vocabulary: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that the automaton knows, from its matching statistics: a word whose longest match has `window` words or more ends one.

    Words that the shard has nowhere match nothing, so the runs between them are streamed.
    """
    n, known = len(words.hash), np.isin(words.hash, vocabulary)
    change = np.ones(n, dtype=bool)
    change[1:] = (known[1:] != known[:-1]) | (words.row[1:] != words.row[:-1])
    begin = np.flatnonzero(change)
    found = []
    for first, last in zip(begin.tolist(), [*begin[1:].tolist(), n], strict=True):
        if known[first] and last - first >= window:
            sizes = automaton.statistics(words.hash[first:last].view(np.int64).tolist())
            found += [first + i - window + 1 for i, size in enumerate(sizes) if size >= window]
    return np.array(found, dtype=np.int64)


def _without(words: Words, out: np.ndarray, r: int, edge) -> str:
    """The words of text r that are not out, joined by one space."""
    text = words.data[words.offsets[r] : words.offsets[r + 1]].tobytes().split()
    gone = out[edge[r] : edge[r + 1]]
    return b" ".join([w for w, x in zip(text, gone.tolist(), strict=True) if not x] if gone.any() else text).decode()


def _clean(window, shard):
    """shard: a broadcast automaton of the crowded windows with its vocabulary and the smallest id of each window's digest; or None."""

    def run(batches):
        automaton, vocabulary, first = shard.value if shard else (None, None, None)
        for batch in batches:
            ids = batch.column(0)
            for a, b in slices(batch.column(1)):
                words, lists = Words(batch.column(1)[a:b]), batch.column(2)[a:b]
                edge = np.searchsorted(words.row, np.arange(b - a + 1))
                starts = [edge[r] + np.asarray(lists[r].values) for r in range(b - a) if lists[r].is_valid]
                if shard and len(words.hash):
                    at = matches(words, automaton, vocabulary, window)
                    if len(at):
                        own = np.asarray(pc.fill_null(ids[a:b], np.iinfo(np.int64).min))[words.row[at]]
                        seen = (first.get(d) for d in zip(*_digests(words, at, window).T.tolist(), strict=True))
                        later = [f is not None and f < mine for f, mine in zip(seen, own.tolist(), strict=True)]
                        starts.append(at[np.array(later, dtype=bool)])
                out = covered(np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64), len(words.hash), window)
                removed = np.diff(np.concatenate([[0], np.cumsum(out)])[edge])
                kept = [_without(words, out, r, edge) for r in range(b - a)]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(np.diff(edge), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return run


def dedup_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, heavy: int = HEAVY) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (words joined by one space)."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = not given.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    known = given.filter("id is not null")
    hot = heavy_keys(known, heavy, rows_of=_anchor_rows(window, anchor, []))

    rows = known.mapInArrow(_anchor_rows(window, anchor, hot), "key long, id long")
    group = Window.partitionBy("key")
    shared = rows.select("key", "id", (F.min("id").over(group) < F.max("id").over(group)).alias("shared")).filter("shared")
    lists = shared.groupBy("id").agg(F.collect_set("key").alias("keys"))
    # both joins with known begin with the same shuffle of texts by id, which is written once
    tag = F.xxhash64("text") if repeated else F.lit(0).cast("long")  # tells rows of one id apart
    marked = known.join(lists, "id", "left").select("id", "text", tag.alias("tag"), "keys")

    crowd = hot_windows(known, hot, window, anchor, heavy)
    first, shard = {(r.k1, r.k2): r.first_id for r in crowd}, None
    if crowd:
        vocabulary = np.unique(np.array([r.words for r in crowd], dtype=np.int64)).view(np.uint64)
        shard = spark.sparkContext.broadcast((SuffixAutomaton([r.words for r in crowd]), np.sort(vocabulary), first))
    rows = marked.mapInArrow(_window_rows(window, anchor, hot, set(first)), "k1 long, k2 int, id long, tag long, pos int")
    group = Window.partitionBy("k1", "k2")
    gone = rows.select("id", "tag", "pos", (F.min("id").over(group) < F.col("id")).alias("later")).filter("later")
    starts = F.collect_set("pos").alias("starts")
    if repeated:  # a document's starts by tag
        gone = gone.groupBy("id", "tag").agg(starts).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "starts"))).alias("by_tag"))
        starts = F.try_element_at("by_tag", tag)
    else:
        gone, starts = gone.groupBy("id").agg(starts), F.col("starts")
    kept = known.join(gone, "id", "left").select("id", "text", starts.alias("starts"))
    rest = given.filter("id is null").select("id", "text", F.lit(None).cast("array<int>").alias("starts"))
    return kept.union(rest).mapInArrow(_clean(window, shard), "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


class SuffixAutomaton:
    """Suffix automaton over words; shards' texts are set apart by a word that no text has."""

    def __init__(self, texts):
        self.link, self.length, self.next = [-1], [0], [{}]
        last = 0
        for text in texts:
            for word in [*text, None]:
                last = self._add(last, word)

    def _add(self, last, word):
        link, length, follow = self.link, self.length, self.next
        at = len(length)
        length.append(length[last] + 1)
        link.append(0)
        follow.append({})
        p = last
        while p >= 0 and word not in follow[p]:
            follow[p][word] = at
            p = link[p]
        if p >= 0:
            q = follow[p][word]
            if length[p] + 1 == length[q]:
                link[at] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                follow.append(dict(follow[q]))
                while p >= 0 and follow[p].get(word) == q:
                    follow[p][word] = copy
                    p = link[p]
                link[q] = link[at] = copy
        return at

    def statistics(self, words):
        """For each word, the length of the longest match that ends there."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                size = 0
            yield size


def _pieces(reference: DataFrame, text_col: str, window: int, size: int) -> DataFrame:
    """piece: the reference's word lists, long texts dealt out in lists of `size` words that overlap by window - 1."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    # the generator's output keeps the split from being repeated for every piece
    texts = reference.select(F.explode(F.array(words)).alias("words")).filter(F.size("words") >= window)
    starts = F.sequence(F.lit(0), F.size("words") - window, F.lit(max(1, size - window + 1)))
    return texts.select(F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, size))).alias("piece"))


def remove_reference_spans(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text", window: int = WINDOW, shard_words: int = 50_000, most_words: int = 1_000_000, most_bytes: int = 64_000_000) -> DataFrame:
    """docs' id, n_words, n_removed, kept_text after removing every match of at least `window` words with the reference.

    The method as named, for a reference within `most_words` words and `most_bytes` bytes: its texts are dealt over
    shards of about `shard_words` words, tasks build the shards' suffix automata, these are broadcast, and documents pass all
    of them in one scan. A larger reference takes an exact way that shuffles: windows of both sides meet on
    their digests, and no side is broadcast.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = cut(_pieces(reference, reference_col, window, shard_words))
    total = pieces.agg(F.sum(F.size("piece")), F.sum(F.octet_length(F.array_join("piece", " ")).cast("long"))).first()
    if (total[0] or 0) > most_words or (total[1] or 0) > most_bytes:
        return _spans_by_digest(given, pieces, window).withColumnRenamed("id", id_col)

    def build(batches):
        texts = [[w.encode() for w in piece] for batch in batches for piece in batch.column(0).to_pylist()]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(SuffixAutomaton(texts))])], ["automaton"])

    built = pieces.repartition(max(1, (total[0] or 0) // shard_words)).mapInArrow(build, "automaton binary").collect()
    shards = spark.sparkContext.broadcast([bytes(r.automaton) for r in built])

    def run(batches):
        automata = [pickle.loads(s) for s in shards.value]
        for batch in batches:
            counts, removed, kept = [], [], []
            for t in batch.column(1):
                words = t.as_py().encode().split()
                out = np.zeros(len(words), dtype=bool)
                for automaton in automata:
                    ends = np.array([i for i, n in enumerate(automaton.statistics(words)) if n >= window], dtype=np.int64)
                    out |= covered(ends - window + 1, len(words), window)
                counts.append(len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    return given.mapInArrow(run, "id long, n_words long, n_removed long, kept_text string").withColumnRenamed("id", id_col)


def _spans_by_digest(given: DataFrame, pieces: DataFrame, window: int) -> DataFrame:
    """remove_reference_spans for a reference of any size; documents are told apart by id and a hash of the text."""

    def windows(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words = Words(batch.column(1)[a:b])
                at = np.flatnonzero(words.grams(window)[1])
                digest, row = _digests(words, at, window), words.row[at]
                pos = at - np.searchsorted(words.row, row)
                part = batch.slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1].astype(np.int32)), part.column(0), part.column(2), pa.array(pos.astype(np.int32))], ["k1", "k2", "id", "tag", "pos"])

    schema = "k1 long, k2 int, id long, tag long, pos int"
    tagged = given.withColumn("tag", F.xxhash64("text"))
    known = pieces.select(F.lit(0).cast("long").alias("id"), F.array_join("piece", " ").alias("text"), F.lit(0).cast("long").alias("tag"))
    known = known.mapInArrow(windows, schema).select("k1", "k2").distinct()
    gone = tagged.mapInArrow(windows, schema).join(known, ["k1", "k2"], "left_semi").groupBy("id", "tag").agg(F.collect_set("pos").alias("starts"))
    gone = gone.withColumnsRenamed({"id": "_id", "tag": "_tag"})
    kept = tagged.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("id", "text", "starts")
    return kept.mapInArrow(_clean(window, None), "id long, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark, sf_dir):
    clean = dedup_corpus(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM d WHERE len(words) >= 13),
k AS (SELECT doc_id, i, md5(array_to_string(words[i:i+12], ' ')) AS k FROM g),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first_id FROM k) WHERE first_id < doc_id),
r AS (SELECT DISTINCT doc_id, i + o AS j FROM f, range(0, 13) AS s(o)),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d),
c AS (SELECT w.doc_id, count(*) AS n_words, count(r.j) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.j) FILTER (r.j IS NULL), '') AS kept
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.j = r.j GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""
