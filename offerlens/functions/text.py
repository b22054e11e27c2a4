"""Text columns. Python's ``\\s`` covers U+3000 and friends, so Java needs ``(?U)``."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
SENTENCE_ENDS = "。！？!?；;"
FLAGS = "(?Ud)"


def squash(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def strip_spaces(text: Column) -> Column:
    """White space off both ends only."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, "")


def blank_to_null(text: Column) -> Column:
    """Empty and missing mean the same thing in captured payloads."""
    return F.nullif(F.trim(text), F.lit(""))


def ascii_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(text, pattern, group)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def has_any(text: Column, words: Iterable[str]) -> Column:
    """Plain look-up of words: a fraction of trying a pattern at every place of a text."""
    return reduce(Column.__or__, [text.contains(w) for w in words])


def behind(text: Column, mark: str) -> Column:
    """What follows the first ``mark`` (one character); empty without one."""
    return F.when(text.contains(mark), F.substring(text, F.instr(text, mark) + 1, F.length(text))).otherwise(F.substring(text, 1, 0))


def any_of(patterns: Iterable[str], flags: str = FLAGS) -> str:
    """One alternation per rule family: one regex pass per sentence instead of one per rule."""
    return flags + "|".join(f"(?:{p})" for p in patterns)


def sentence_list(text: Column) -> Column:
    """Array of squashed, non-blank sentences in document order."""
    # A line break behind every end of a sentence, as plain replacements: no pattern is tried at every place.
    broken = reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(e + "\n")), SENTENCE_ENDS, text)
    return F.filter(F.transform(F.split(broken, "\n"), squash), lambda s: s != "")


def head(items: Column) -> Column:
    """First element or NULL (ANSI mode raises on an empty array otherwise)."""
    return F.get(items, 0)


def number_text(value: Column) -> Column:
    """``20.0`` reads ``20``; ``3.5`` stays ``3.5``."""
    return F.when(value == F.floor(value), F.floor(value).cast("bigint").cast("string")).otherwise(
        value.cast("string")
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once.

    Lambda bodies are interpreted without common-subexpression elimination, so
    an expression used several times there would run several times.
    """
    return F.get(F.transform(F.array(value), body), 0)
