"""Content ids and keyword classes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions.text import let, strip

BAR = "|"


def content_id(nl: Column, formula: Column) -> Column:
    """12 hex digits of sha-256 over the lower-cased statement and the formula."""
    return F.substring(F.sha2(F.concat(F.lower(strip(nl)), F.lit(BAR), strip(formula)), 256), 1, 12)


def pair_id(nl: Column, formula: Column) -> Column:
    """12 hex digits of md5 over the exact pair."""
    return F.substring(F.md5(F.concat(nl, F.lit(BAR), formula)), 1, 12)


def statement_hash(nl: Column) -> Column:
    """md5 of the normalised statement; rows with equal hash are one statement."""
    return F.md5(strip(F.lower(nl)))


def statement_id(nl: Column) -> Column:
    return F.substring(statement_hash(nl), 1, 12)


def seeded(key: Column, seed: int) -> Column:
    """Order key of every random choice: the same for any partitioning or retry."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def seeded_choice(key: Column, seed: int, n: Column | int) -> Column:
    """Index in [0, n) chosen by the seeded hash of a key."""
    n = F.lit(n) if isinstance(n, int) else n
    return (F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def domain_of(
    nl: Column,
    formula: Column,
    words: dict[str, list[str]] | None = None,
    whole_words: bool = False,
) -> Column:
    """Domain with most of its words in the text; ties go to the earlier domain."""
    words = words or vocab.DOMAIN_WORDS
    names, width = list(words), len(words)
    most = max(len(m) for m in words.values())
    # score and rank in one number, so that the best one is computed once
    table = F.lit([vocab.GENERIC_DOMAIN] * width + names[::-1] * most)

    def best(text: Column) -> Column:
        codes = [_hits(text, members, whole_words) * width + (width - 1 - rank) for rank, members in enumerate(words.values())]
        return F.greatest(*codes) if width > 1 else codes[0]

    text = F.lower(F.concat(nl, F.lit(" "), formula))
    # written out, a few dozen plain tests are one method that is too large to be compiled; over a list they take half the time
    return F.element_at(table, (best(text) if whole_words else let(text, best)) + 1)


def _hits(text: Column, words: list[str], whole_words: bool) -> Column:
    """How many of the words are in the text."""
    if whole_words:  # patterns are literals, so that each is compiled once
        return reduce(add, [F.regexp_like(text, F.lit(rf"\b\Q{w}\E\b")).cast("int") for w in words])
    return F.size(F.filter(F.lit(words), lambda w: F.contains(text, w)))
