"""URL filter: host rules first, then a weighted vocabulary.

Rules name a host with all its subdomains and the beginning of a path; the longest that
fits decides. Where none fits, an Aho-Corasick automaton finds every term of
the vocabulary in the lower-cased (A-Z) url in one pass; a hit counts where neither
neighbour is an ASCII letter or digit. One strict term rejects, and so do `enough`
distinct soft terms. Null urls, and urls without "://", have an empty host and path,
so no rule fits them; the vocabulary still judges what text there is (null: allow). Every row is judged
by itself, so repeated rows and skew don't matter; a very long url is searched whole, in one pass; other columns are not read,
whatever their names; an empty table stays empty.

The vocabulary is a table (term, kind: strict or soft) of at most MOST_TERMS rows and MOST_BYTES bytes, which the driver reads and
broadcasts; a larger one is refused. Each task builds its automaton once. Without a table, the lists below are used,
each word also with an s.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The rules of the contract, (verdict, host/path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Words that reject alone, and words that count together.
STRICT = (
    "babes", "bestiality", "blackjack", "botnet", "camgirl", "carding", "casino", "crackz", "cumshot", "darknet", "fap", "gangbang", "hentai", "hookup", "incest", "jackpot", "keylogger",
    "malware", "milf", "nude", "onlyfans", "orgasm", "phishing", "porn", "pornhub", "ransomware", "roulette", "serialz", "sexcam", "slut", "spyware", "threesome", "trojan", "viagra",
    "warez", "whore", "xanax", "xnxx", "xvideo", "xxx",
)
SOFT = (
    "ad", "adult", "affiliate", "amateur", "auction", "bet", "betting", "bonus", "cash", "cheap", "cialis", "click", "clickbait", "coupon", "crack", "credit", "dating", "deal", "debt",
    "dice", "discount", "download", "drug", "earn", "erotic", "escort", "farm", "fetish", "forex", "free", "gamble", "gambling", "hack", "hot", "keygen", "kinky", "lesbian", "lingerie",
    "loan", "lottery", "lotto", "money", "mortgage", "naked", "nulled", "offer", "payday", "pharmacy", "pill", "pirate", "poker", "popup", "prize", "profit", "promo", "proxy", "replica",
    "sale", "seo", "sex", "sexy", "singles", "slot", "spam", "steroid", "streaming", "stripper", "survey", "swinger", "teen", "tobacco", "torrent", "track", "tracker", "traffic",
    "twink", "unlock", "vape", "vip", "voyeur", "wager", "weed", "win", "winner",
)
ENOUGH, MOST_TERMS, MOST_BYTES = 2, 1_000_000, 32_000_000


def default_terms() -> dict[str, bool]:
    """term -> whether it is strict."""
    return {w + end: kind for words, kind in ((SOFT, False), (STRICT, True)) for w in words for end in ("", "s")}


def read_terms(vocabulary: DataFrame | None) -> dict[str, bool]:
    """The terms of a table (term, kind), lower-cased; null and empty terms don't count, strict wins."""
    if vocabulary is None:
        return default_terms()
    term = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = vocabulary.select(term.alias("term"), (F.col("kind") == "strict").alias("strict")).filter("term != ''").groupBy("term").agg(F.coalesce(F.max("strict"), F.lit(False)).alias("strict"))
    n, size = terms.agg(F.count("*"), F.sum(F.octet_length("term"))).first()
    if n > MOST_TERMS or (size or 0) > MOST_BYTES:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms and {MOST_BYTES} bytes")
    return {r.term: r.strict for r in terms.collect()}


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, begin = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + begin)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rules else (F.lit(None).cast("string"),) * 2


_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(65, 91)}


def count(automaton, url: str) -> tuple[int, int]:
    """Strict hits and distinct soft hits of a url."""
    n, kinds = 0, set()
    for end, (term, strict) in automaton.iter(url) if len(automaton) else ():
        start = end - len(term) + 1
        if (start and url[start - 1] in _INNER) or (end + 1 < len(url) and url[end + 1] in _INNER):
            continue
        if strict:
            n += 1
        else:
            kinds.add(term)
    return n, len(kinds)


def hits(spark: SparkSession, terms: dict[str, bool]):
    """A pandas UDF: struct of strict hits and distinct soft hits of each url."""
    shared = spark.sparkContext.broadcast(terms)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, strict in shared.value.items():
            automaton.add_word(term, (term, strict))
        automaton.make_automaton()
        for urls in parts:
            yield pd.DataFrame([count(automaton, (url or "").translate(_LOWER)) for url in urls], columns=["strict", "soft"])

    return F.pandas_udf(run, "strict int, soft int")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, vocabulary: DataFrame | None = None, enough: int = ENOUGH) -> DataFrame:
    """id, host, path, rule, verdict, strict_hits, soft_hits of every row."""
    url = F.col(url_col)
    x = pages.select(F.col(id_col), url.alias("_url"), host_of(url).alias("host"), path_of(url).alias("path"), hits(pages.sparkSession, read_terms(vocabulary))(url).alias("_hits"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.withColumn("rule", rule).withColumn("_rule_verdict", verdict)
    own = F.when((F.col("_hits.strict") > 0) | (F.col("_hits.soft") >= enough), "block").otherwise("allow")
    return x.select(id_col, "host", "path", "rule", F.coalesce("_rule_verdict", own).alias("verdict"), F.col("_hits.strict").cast("long").alias("strict_hits"), F.col("_hits.soft").cast("long").alias("soft_hits"))


def op3_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    terms = {kind: ", ".join(f"'{t}'" for t, strict in default_terms().items() if strict == kind) for kind in (True, False)}

    rules = " ".join(
        f"WHEN (host = '{t.split('/')[0]}' OR ends_with(host, '.{t.split('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{t}'"
        for _, t in sorted(RULES, key=lambda r: -len(r[1]))
    )
    verdicts = " ".join(f"WHEN rule = '{t}' THEN '{v}'" for v, t in RULES)
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract_all(low, '[a-z0-9]+') AS words FROM u),
r AS (SELECT *, CASE {rules} END AS rule, len(list_filter(words, lambda w: w IN ({terms[True]}))) AS strict_hits,
  len(list_distinct(list_filter(words, lambda w: w IN ({terms[False]})))) AS soft_hits FROM p)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN strict_hits > 0 OR soft_hits >= {ENOUGH} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits::BIGINT AS strict_hits, soft_hits::BIGINT AS soft_hits FROM r"""


SQL = _sql()
