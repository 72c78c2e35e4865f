"""Column -> Column helpers for plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SPACE = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    """Both-end strip of all whitespace, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def strip_short(c: Column) -> Column:
    """The same without a pattern, which is much faster; for formulas and answers, as it takes eight bytes a byte."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def count_of(c: Column, piece: str) -> Column:
    """Occurrences of a literal piece, without overlaps."""
    gone = F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))
    return gone if len(piece) == 1 else F.floor(gone / F.lit(len(piece))).cast("int")


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def contains_any(c: Column, pieces: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in pieces])


def canonical_set(arr: Column) -> Column:
    """Arrays that stand for sets are kept sorted, so equal sets are equal values."""
    return F.sort_array(F.array_distinct(arr))


GAP = "\x01"


def strings_present(parts: list[Column]) -> Column:
    """Array of the parts that are not null.

    Goes through one joined string: unlike the lambda behind array_compact this
    stays in generated code, where common parts are computed once.
    """
    return F.array_remove(F.split(F.concat_ws(GAP, *parts), GAP), "")


def members(list_text: Column) -> Column:
    """Comma-separated text to its trimmed members."""
    return F.split(strip(list_text), r"\s*,\s*")


def drop_prefixes(c: Column, prefixes: list[str], ignore_case: bool = False) -> Column:
    """Each prefix in turn is dropped, with the space after it, where the text starts with it."""
    flag = "(?i)" if ignore_case else ""
    return reduce(lambda acc, p: F.regexp_replace(acc, rf"{flag}\A\Q{p}\E\s*", ""), prefixes, c)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, for costly values that are used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cut(c: Column, n: int) -> Column:
    """First n characters, as used for report keys."""
    return F.substring(c, 1, n)
