"""Small builders that turn rule tables into column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode_regex(pattern: str) -> str:
    """Case-insensitive, Unicode-aware form of a rule pattern for the JVM engine."""
    return "(?iU)" + pattern


def matches(col: Column, pattern: str) -> Column:
    """True when the pattern occurs in the text; a null text never matches."""
    return F.coalesce(col.rlike(unicode_regex(pattern)), F.lit(False))


def first_match(col: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """Label of the first rule whose pattern occurs in the text."""
    out = None
    for label, pattern in rules:
        hit = matches(col, pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def all_matches(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Array of every label whose pattern occurs, in rule order, without repeats."""
    hits = [F.when(matches(col, pattern), F.lit(label)) for label, pattern in rules]
    return F.array_distinct(F.array_compact(F.array(*hits)))


def word_rules(words: list[str]) -> list[tuple[str, str]]:
    """One whole-word rule per vocabulary entry."""
    return [(w, rf"\b{re.escape(w)}\b") for w in words]


def any_word(words: list[str]) -> str:
    """A pattern that finds any of the words as a whole word."""
    return r"\b(?:" + "|".join(re.escape(w) for w in words) + r")\b"


def contains_any(col: Column, cues: list[str]) -> Column:
    """Plain substring test against a list of cues."""
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(col, F.lit(cue))
    return F.coalesce(out, F.lit(False))


def contains_word(text: Column, word: Column) -> Column:
    """Whole-word test where the word itself is a column (quoted, so never a pattern)."""
    quoted = F.concat(F.lit(r"(?iU)\b\Q"), word, F.lit(r"\E\b"))
    return F.coalesce(F.rlike(text, quoted), F.lit(False))


def blank(col: Column) -> Column:
    """Null, empty or whitespace-only."""
    return ~F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))


def strip(col: Column) -> Column:
    """Remove every kind of white space at both ends."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def strings(values: list[str]) -> Column:
    """A constant array of strings."""
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def tidy(col: Column, digits: int) -> Column:
    """Round so that a tie in the decimal value is a tie here too, whatever its binary form."""
    return F.round(F.round(col, 10), digits)
