"""Quality rules, line first, in DataFrame functions alone.

Each line is judged by three rules and dropped when it fails one:

- punctuation: it must end like a sentence, or have `long_line` words; symbols
  may not outnumber half its words; in lines of 5 words or more, ! and ? together may
  not reach half the words;
- navigation: it may not have 3 or more separators (| › » •) with at most
  `nav_words` words for each;
- boilerplate: in lines of under `long_line` words, no stock phrase.

Blank lines pass. A document is rejected when the lines left hold less than
`least_left` percent of the characters in its lines with words, or when it fails the base
rules: under 10 words, or over 20 % of its words in 5-word windows found twice
or more in the text. Null text counts as empty and so fails; null ids and
extra columns pass through, whatever their names, in one struct; repeated rows are judged alike; an empty table stays empty. A very
long text is judged whole, by arrays of its lines, words and windows. Windows are
compared by their 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?:;…"'”’»)\]。！？][\x20\x09-\x0D]*\z"""
#: Stock phrases, as whole words.
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie settings", "accept cookies", "use cookies", "uses cookies", "use a cookie", "enable javascript",
    "sign up", "log in", "click here", "read more", "subscribe", "newsletter", "lorem ipsum", "share on", "alle rechte vorbehalten", "datenschutz", "nutzungsbedingungen", "mehr lesen", "weiterlesen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "lire la suite", "todos los derechos reservados", "política de privacidad", "aviso legal", "leer más",
)
_PHRASE = f"(^|[^A-Za-z])({'|'.join(PHRASES)})([^A-Za-z]|$)"
LONG_LINE, NAV_WORDS, LEAST_LEFT = 20, 4, 50


def _words(text):
    return F.array_remove(F.split(text, GAP), "")


def _count(text, chars: str):
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def judge(docs: DataFrame, text_col: str = "text", long_line: int = LONG_LINE, nav_words: int = NAV_WORDS, least_left: int = LEAST_LEFT) -> DataFrame:
    """docs' columns as struct `row`, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text."""

    def facts(line):
        return F.struct(line.alias("text"), F.size(_words(line)).alias("n"), _count(line, SYMBOLS).alias("symbols"), F.char_length(line).alias("chars"))

    def passes(x):
        n, text = x["n"], x["text"]
        # the cheap rules first; a line that fails one is not judged by the rest
        symbols = 2 * x["symbols"] <= n
        calm = (n < 5) | (2 * _count(text, "!?") < n)
        bars = _count(text, "|›»•")
        navigation = (bars >= 3) & (n <= bars * nav_words)
        ends = (n >= long_line) | text.rlike(SENTENCE_END)
        stock = (n < long_line) & text.rlike("(?iu)" + _PHRASE)
        return (n == 0) | (symbols & ends & calm & ~navigation & ~stock)

    def window(words):
        return lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    x = docs.select(F.struct("*").alias("row"), text.alias("text"))
    x = x.select("row", _words(F.col("text")).alias("words"), F.transform(F.split("text", "\n"), facts).alias("lines"))
    n = F.size("words")
    x = x.select(
        "row", n.cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window(F.col("words")))).otherwise(F.array().cast("array<long>")).alias("windows"),
        "lines", F.filter("lines", passes).alias("good"), F.filter("lines", lambda a: a["n"] > 0).alias("full"),
    )
    # only texts with a repeated window sort theirs
    pairs = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn("pairs", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs)).drop("windows")
    same = F.filter("pairs", lambda a, i: (a["h"] == F.get("pairs", i - 1)["h"]) | (a["h"] == F.get("pairs", i + 1)["h"]))
    x = x.withColumn("starts", F.array_sort(F.transform(same, lambda a: a["i"]))).drop("pairs")
    covered = F.aggregate(
        "starts", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"],
    )

    def total(lines, name):
        return F.aggregate(F.transform(lines, lambda a: a[name]), F.lit(0).cast("long"), lambda s, v: s + v)

    x = x.select(
        "row", "n_words", "word_chars", total("lines", "symbols").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct(F.transform("full", lambda a: a["text"])))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        total("full", "chars").alias("line_chars"), total(F.filter("good", lambda a: a["n"] > 0), "chars").alias("left_chars"),
        F.array_join(F.transform("good", lambda a: a["text"]), "\n").alias("clean_text"),
    )
    x = x.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return x.withColumn("kept", ~F.col("base_failed") & (100 * F.col("left_chars") >= least_left * F.col("line_chars")))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with the failing lines taken out; n_chars follows where there is one."""
    # a filter on `kept` would be pushed below the projections and repeat all their work; a generator's output isn't
    kept = judge(docs, text_col).select(F.explode_outer(F.array(F.when(F.col("kept"), F.struct("row", "clean_text")))).alias("x")).filter("x is not null")
    new = {text_col: F.col("x.clean_text"), "n_chars": F.char_length("x.clean_text").cast("long")}
    return kept.select(*[(new[c] if c in new else F.col("x.row")[c]).alias(c) for c in docs.columns])


def op5_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_chars", "left_chars"
    )


_LINE = r"list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS c FROM g),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM h, range(0, 5) AS o(k) WHERE c > 1) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
l1 AS (SELECT doc_id, l, len(LIST_WORDS) AS n, length(l) AS chars,
  length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) AS symbols,
  length(l) - length(regexp_replace(l, '[!?]', '', 'g')) AS bangs,
  length(l) - length(regexp_replace(l, '[|›»•]', '', 'g')) AS bars FROM l0),
l2 AS (SELECT *, n = 0 OR ((regexp_matches(l, '[.!?:;…"''”’»)\]。！？][\x20\x09-\x0D]*\z') OR n >= 20) AND 2 * symbols <= n
  AND (n < 5 OR 2 * bangs < n) AND NOT (bars >= 3 AND n <= bars * 4)
  AND NOT (n < 20 AND regexp_matches(l, 'PHRASES'))) AS good FROM l1),
l3 AS (SELECT doc_id, sum(symbols) AS n_symbols, count(*) FILTER (n > 0) - count(DISTINCT l) FILTER (n > 0) AS n_dup_lines,
  sum(chars) FILTER (n > 0) AS line_chars, sum(chars) FILTER (n > 0 AND good) AS left_chars FROM l2 GROUP BY doc_id),
a AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(line_chars, 0)::BIGINT AS line_chars,
  coalesce(left_chars, 0)::BIGINT AS left_chars FROM w JOIN l3 USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * left_chars >= 50 * line_chars AS kept, line_chars, left_chars FROM a
""".replace("LIST_WORDS", _LINE).replace("PHRASES", "(?i)" + _PHRASE)
