"""Words of a text in order: what the rules on labels, frequencies and instructions look up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once: a fold over no elements binds it to a variable, without an array or a copy of it."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def words_of(text: Column) -> Column:
    """The words between blanks, a slash being a word of its own."""
    return F.split(F.trim(F.regexp_replace(text, "/", " / ")), r"\s+")


def keys_of(words: Column) -> Column:
    """Each word in lower case without marks inside or around it: 'p.m.' is 'pm', 'take-home' is 'takehome'."""
    return F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9/]", ""))


def within(word: Column, table) -> Column:
    return word.isin(*table)


def in_order(*sets: tuple[str, ...], gap: int = 6) -> str:
    """A pattern for a word of each set in turn, at most `gap` other words between two of them. A set may hold phrases of several words."""
    one = lambda words: "(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + ")"
    return r"(?i)\b" + (r"\b(?:\W+\w+){0,%d}?\W+" % gap).join(map(one, sets)) + r"\b"
