"""How a title finds its record, and how a record gives its value."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys and lengths that decide results.
LIST_MATCH_KEYS = ("question_title", "title", "question", "name")
LIST_VALUE_KEYS = ("value_text", "answer", "text", "value", "response")
ARRAY_MATCH_KEYS = ("question_title", "title", "question", "name", "label", "key")
ARRAY_VALUE_KEYS = (
    "value_text", "value", "text", "answer", "response", "description", "comment",
)
PATTERN_LENGTH = 30


def make_pattern(title: str, length: int | None = None) -> str:
    """The part of a title that is searched for: all of it, or its first ``length`` characters."""
    return title[:length]


def has_wildcards(pattern: str) -> bool:
    """True where plain text search would not do: ``%``, ``_`` or nothing."""
    return pattern == "" or "%" in pattern or "_" in pattern


def like_literal(pattern: str) -> Column:
    """Lower-case LIKE pattern for "contains"; ``%`` and ``_`` stay wildcards."""
    return F.lower(F.lit("%" + pattern.replace("\\", "\\\\") + "%"))


def contains_pattern(lowered: Column, pattern: str) -> Column:
    """Whether lower-case text contains the pattern."""
    if has_wildcards(pattern):
        return F.like(lowered, like_literal(pattern))
    return F.contains(lowered, F.lower(F.lit(pattern)))


def matches(record: Column, keys: Iterable[str], pattern: str) -> Column:
    """Whether any of ``keys`` contains the pattern, ignoring case."""
    tests = (
        F.coalesce(contains_pattern(F.lower(record[k]), pattern), F.lit(False)) for k in keys
    )
    return reduce(lambda a, b: a | b, tests)


def pick_value(record: Column, keys: Iterable[str], default: str | None = "") -> Column:
    """The first value that is not null, in key order.  An empty text counts."""
    return F.coalesce(*[record[k] for k in keys], F.lit(default))


def unused_character(texts: Sequence[str]) -> str:
    """A control character that occurs in none of ``texts``."""
    seen = set().union(*texts) if texts else set()
    return next(c for c in map(chr, range(1, 0x110000)) if c not in seen)
