"""Descriptions found in page text, as Column expressions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.work import bound
from .text import noisy_description, scent_summary

#: Headings before a description, and labels (with a colon) that end it.
MORE, SECTION = "More information", "Description|Product details|About (?:this|the) (?:product|candle)"
SECTION_END = "Dimensions|Weight|Burning time|Burn time|PACKAGING|IMPORTANT|Tasting Notes|Ingredients|YOU MAY ALSO"
MORE_END = SECTION_END + "|YOUR UNBOXING"
#: Least characters and words of a paragraph that can stand in for a description.
PARAGRAPH_CHARS, PARAGRAPH_WORDS = 80, 12
_TAGLINE = rf"(?im)^([A-Z][^\n]{{40,}}\.)\s*\n+{MORE}\s*\n"


def tidy(x: Column) -> Column:
    """Runs of spaces as one, of blank lines as one, ends trimmed."""
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"\A\s+|\s+\z", "")


def _below(x: Column, heading: str, end: str) -> Column:
    return F.regexp_extract(x, rf"(?is)(?:{heading})\s*\n+(.+?)(?=\n(?:{end})\s*:|\z)", 1)


def _clean(x: Column) -> Column:
    """x tidied, or null if it is empty or reads like page furniture."""
    x = tidy(x)
    return F.when(~noisy_description(x), x)


def _longest(candidates: Column) -> Column:
    """The longest of an array, the first of equals; nulls don't count, none gives null."""
    ranked = F.transform(F.array_compact(candidates), lambda v, i: F.struct(F.char_length(v).alias("n"), (-i).alias("i"), v.alias("v")))
    return F.array_max(ranked)["v"]


def description_in(x: Column) -> Column:
    """The tagline and text about "More information"; else a headed section; else the longest good paragraph; else null."""
    more = F.array_compact(F.array(_clean(F.regexp_extract(x, _TAGLINE, 1)), _clean(_below(x, MORE, MORE_END))))
    blocks = F.transform(F.split(x, r"\n{2,}"), tidy)
    words = lambda b: F.size(F.split(b, r"\s+"))
    good = F.filter(blocks, lambda b: (F.char_length(b) >= PARAGRAPH_CHARS) & b.contains(".") & (words(b) >= PARAGRAPH_WORDS) & ~noisy_description(b))
    return F.coalesce(F.when(F.size(more) > 0, tidy(F.array_join(more, "\n\n"))), _clean(_below(x, SECTION, SECTION_END)), _longest(good))


def pick_description(listed: Column, model: Column, page: Column) -> Column:
    """The longest clean one of listed and model; else what the page, then either of the two, holds; else the first of the two as it is."""
    given = [F.nullif(F.trim(c), F.lit("")) for c in (listed, model)]
    clean = _longest(F.array(*[F.when(~noisy_description(c), c) for c in given]))
    return F.coalesce(clean, description_in(page), *[description_in(c) for c in given], *given)


# Stages by their labels, labels of lists of notes, accords looked for, in order.
STAGES = (("top", "top"), ("heart", "middle"), ("middle", "middle"), ("base", "base"))
LISTS = ("tasting notes", "notes", "fragrance notes", "olfactory notes")
ACCORDS = ("woody", "vanilla", "citrus", "floral", "gourmand", "amber", "smoky", "spicy", "fresh", "musky", "powdery", "fruity", "green", "balsamic", "leather", "aquatic", "aromatic", "sweet", "warm")
_NOTE = "array<struct<name: string, stage: string>>"


def _names(chunk: Column, stage: str, least: int, numbered: bool = False) -> Column:
    """Names of a list by commas and the word and; those of under `least` characters don't count."""
    parts = F.transform(F.split(chunk, r",|\band\b"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", ""))
    if numbered:
        parts = F.transform(parts, lambda p: F.regexp_replace(p, r"\A[\d.]+\s*", ""))
    return F.transform(F.filter(parts, lambda p: F.char_length(p) >= least), lambda p: F.struct(p.alias("name"), F.lit(stage).alias("stage")))


def notes_in(x: Column) -> Column:
    """array<struct<name, stage>> of the notes that a description tells: a line of tasting notes; else what stands behind the first label of a list, by stages where it has any."""
    return _notes(x, _inline(x))


def _inline(x: Column) -> Column:
    return _names(F.nullif(F.regexp_extract(x, r"(?i)tasting\s+notes\s*:\s*([^\n]+)", 1), F.lit("")), "unknown", 3)


def _notes(x: Column, line: Column) -> Column:
    # the text behind the first label that is found, up to the next line that begins with a capital letter
    chunk = F.coalesce(*[F.nullif(F.regexp_extract(x, rf"(?is){label}\s*:?\s*(.+?)(?:\n[A-Z]|\z)", 1), F.lit("")) for label in LISTS])
    return F.coalesce(F.when(F.size(line) > 0, line), bound(chunk, _told), F.array().cast(_NOTE))


def _told(chunk: Column) -> Column:
    staged = F.concat(*[F.coalesce(_names(F.nullif(F.regexp_extract(chunk, rf"(?i){label}\s*:\s*([^.;]+)", 1), F.lit("")), stage, 1), F.array().cast(_NOTE)) for label, stage in STAGES])
    return bound(staged, lambda s: F.when(F.size(s) > 0, s).otherwise(_names(chunk, "unknown", 3, numbered=True)))


def accords_in(x: Column) -> Column:
    """Names of the accords that a description has, in the fixed order; the family it names comes first unless it is one of them."""
    found = lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(a)), F.lit(a)) for a in ACCORDS]))
    return bound(bound(F.lower(x), found), lambda some: bound(scent_summary(x), lambda family: _with_family(some, family)))


def _with_family(found: Column, family: Column) -> Column:
    with_family = F.when(family.isNotNull() & ~F.array_contains(found, F.lower(family)), F.concat(F.array(family), found)).otherwise(found)
    return F.coalesce(with_family, F.array().cast("array<string>"))


def notes_and_accords(x: Column) -> Column:
    """struct of notes and accords; a text with a line of tasting notes is asked for no accords."""
    def told(text, line):
        accords = F.when(F.coalesce(F.size(line), F.lit(0)) > 0, F.array().cast("array<string>")).otherwise(accords_in(text))
        return F.struct(_notes(text, line).alias("notes"), accords.alias("accords"))

    return bound(x, lambda text: bound(_inline(text), lambda line: told(text, line)))
