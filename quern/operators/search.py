"""Searches over an inverted index, given as structured terms: words, phrases, prefixes and fields.

A phrase is judged on positions; everything else is a boolean over which words a document has, so a search is one
pass over the postings of its words and one group per document.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Term(NamedTuple):
    """A word, or several in a row (a phrase); prefix lets the last go on; field keeps to one column. Case doesn't count."""

    text: str
    field: str | None = None
    prefix: bool = False

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(r"[\W_]+", self.text.lower()) if w]


def postings(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, token, position."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("text")) for c in columns])).alias("f")
    words = F.filter(F.split(F.lower("f.text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return rows.select(key, each).select(key, "f.field", F.posexplode(words).alias("position", "token"))


def _is(term: Term, i: int) -> Column:
    """Whether a posting is the term's i-th word."""
    words = term.words
    token = F.col("token").startswith(words[i]) if term.prefix and i == len(words) - 1 else F.col("token") == words[i]
    return token if term.field is None else token & (F.col("field") == term.field)


def _has(term: Term) -> Column:
    """Over the postings of one document: whether the term is there."""
    n = len(term.words)
    if n == 1:
        return F.bool_or(_is(term, 0))
    # where the phrase would begin, told by each of its words
    begins = [F.collect_set(F.when(_is(term, i), F.struct("field", (F.col("position") - i).alias("begin")))) for i in range(n)]
    return F.size(reduce(F.array_intersect, begins)) > 0


def search(index: DataFrame, key: str, every: list[Term] = (), either: list[list[Term]] = (), without: list[Term] = ()) -> DataFrame:
    """The keys, each once, of documents with every term, one at least of each group of `either`, and none of `without`.

    Terms without a word are left out, and so are groups of such terms. A search of exclusions alone matches nothing.
    """
    groups = [[t for t in group if t.words] for group in [*([t] for t in every), *either]]
    groups, barred = [g for g in groups if g], [t for t in without if t.words]
    if not groups:
        return index.select(key).limit(0)
    terms = {t: f"h{i}" for i, t in enumerate(dict.fromkeys([*sum(groups, []), *barred]))}
    wanted = reduce(Column.__or__, [_is(t, i) for t in terms for i in range(len(t.words))])
    hits = index.filter(wanted).groupBy(key).agg(*[_has(t).alias(h) for t, h in terms.items()])
    found = [reduce(Column.__or__, [F.col(terms[t]) for t in g]) for g in groups] + [~F.col(terms[t]) for t in barred]
    return hits.filter(reduce(Column.__and__, found)).select(key)
