"""Column -> Column functions over formula text.

All of them are built-in expressions, so a scan that only needs one feature
reads one column and stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions.text import (
    canonical_set, contains_any, let, members, replace_all, strip, strip_short, strings_present,
)

COALITION = r"<<([^>]+)>>"
IDENTIFIER = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b"
LOWER_IDENTIFIER = r"\b[a-z][a-z0-9_]*\b"


def to_ascii(f: Column) -> Column:
    return strip_short(replace_all(f, vocab.ASCII_FORMS))


def to_printed(f: Column) -> Column:
    return strip_short(replace_all(f, vocab.PRINTED_FORMS))


def agents(f: Column) -> Column:
    """Agents of all coalitions, as a sorted set."""
    groups = F.array_join(F.regexp_extract_all(to_ascii(f), F.lit(COALITION), F.lit(1)), ",")
    return canonical_set(_none_if_empty(groups))


def _none_if_empty(list_text: Column) -> Column:
    """Members of a list text; no member when the text is empty.

    Written without a branch around the members, so that the text is computed once.
    """
    return F.slice(members(list_text), F.lit(1), F.when(list_text == "", 0).otherwise(2**31 - 1))


def first_coalition(f: Column) -> Column:
    """Agents of the first coalition in written order; empty when there is none."""
    group = F.regexp_extract(f, COALITION, 1)
    return _none_if_empty(group)


def temporal_operators(f: Column) -> Column:
    """G F X U in this order, then ->.

    An operator letter counts as a word of its own, or anywhere before a blank
    or an opening parenthesis.
    """
    a = to_ascii(f)
    found = [
        F.when(F.regexp_like(a, F.lit(rf"\b{op}\b|{op}\s*\(|{op}\s+")), F.lit(op)) for op in ["G", "F", "X", "U"]
    ]
    return strings_present([*found, F.when(F.contains(a, F.lit("->")), F.lit("->"))])


def operators(f: Column, mode: str = "substring") -> Column:
    """G F X U W R, then & | -> !, by plain substring or by word boundary."""
    if mode == "substring":
        letters = {op: F.contains(f, F.lit(op)) for op in "GFXUWR"}
        marks = {"&": ["&"], "|": ["|"], "->": ["->"], "!": ["!"]}
    elif mode == "boundary":
        letters = {op: F.regexp_like(f, F.lit(rf"\b{op}\b|\b{op}\(")) for op in "GFXUWR"}
        marks = {"&": ["&", "∧"], "|": ["|", "∨"], "->": ["->", "→"], "!": ["!", "¬"]}
    elif mode == "loose":
        return temporal_operators(f)
    else:
        raise ValueError(f"unknown mode: {mode}")
    found = {**letters, **{k: contains_any(f, v) for k, v in marks.items()}}
    return strings_present([F.when(hit, F.lit(op)) for op, hit in found.items()])


def atoms(f: Column) -> Column:
    """Identifiers outside coalitions that are neither operators nor words, as a sorted set."""
    body = F.regexp_replace(to_ascii(f), r"<<[^>]+>>", "")
    body = F.regexp_replace(body, r"\b(G|F|X|U)\b", " ")
    body = F.regexp_replace(body, r"[!&|()>\-<]", " ")
    body = F.regexp_replace(body, _any_word(vocab.NOT_ATOMS, "(?i)"), " ")
    return canonical_set(F.regexp_extract_all(body, F.lit(IDENTIFIER), F.lit(0)))


def _any_word(words: list[str], flag: str = "") -> str:
    return rf"{flag}\b({'|'.join(words)})\b"


def identifiers(f: Column, lowered: bool = False) -> Column:
    """Lower-case identifiers, agents included.

    Plain: in written order with repeats. Lowered: of the lower-cased text, as a sorted set.
    """
    drop = vocab.NOT_IDENTIFIERS_LOWERED if lowered else vocab.NOT_IDENTIFIERS
    text = F.regexp_replace(F.lower(f) if lowered else f, _any_word(drop), " ")
    names = F.regexp_extract_all(text, F.lit(LOWER_IDENTIFIER), F.lit(0))
    return canonical_set(names) if lowered else names


def pattern(f: Column) -> Column:
    """Temporal pattern; the first match in this order wins."""
    tight = F.replace(f, F.lit(" "), F.lit(""))

    def has(*pieces: str) -> Column:
        return contains_any(tight, list(pieces))

    until = has(")U(") | contains_any(f, [" U ", ")U "])
    return (
        F.when(has("G(F"), "recurrence")
        .when(has("F(G"), "persistence")
        .when(has("G(") & has("->F("), "response")
        .when(until, "until")
        .when(has("G(!", "G(¬"), "safety")
        .when(has("G("), "invariant")
        .when(has("F("), "liveness")
        .otherwise("unknown")
    )


def same_formula(a: Column, b: Column) -> Column:
    """Equal up to operator spelling, whitespace and case."""

    def flat(f: Column) -> Column:
        return F.lower(F.regexp_replace(to_ascii(f), r"\s+", ""))

    return flat(a) == flat(b)


def complexity(ops: Column, atom_set: Column, f: Column) -> Column:
    """Operators plus atoms, +2 for an implication with F, +1 for G with F."""
    has_f = F.contains(f, F.lit("F"))
    return (
        F.size(ops)
        + F.size(atom_set)
        + F.when(F.contains(f, F.lit("->")) & has_f, 2).otherwise(0)
        + F.when(F.contains(f, F.lit("G")) & has_f, 1).otherwise(0)
    )


def complexity_bucket(score: Column) -> Column:
    return F.when(score <= 3, "low").when(score <= 6, "medium").otherwise("high")


def _is_number(a: Column) -> Column:
    return F.regexp_like(a, F.lit(r"^[0-9]+$"))


def sorted_members(coalition: Column) -> Column:
    """Distinct agents, named ones before numbered ones, each by text."""
    keyed = F.transform(
        F.array_distinct(coalition), lambda a: F.struct(_is_number(a).alias("number"), a.alias("agent"))
    )
    return F.when(F.size(coalition) == 1, coalition).otherwise(F.transform(F.sort_array(keyed), lambda s: s["agent"]))


def coalition_text(coalition: Column) -> Column:
    """English phrase of a coalition: one, two, or three and more agents."""
    return let(sorted_members(coalition), members_text)


def members_text(sorted_agents: Column) -> Column:
    """The same of agents that are in the order of ``sorted_members``."""
    own = F.create_map(*[F.lit(x) for kv in vocab.AGENT_PHRASES.items() for x in kv])

    def with_article(a: Column) -> Column:
        return F.when(_is_number(a), F.concat(F.lit("agent "), a)).otherwise(F.concat(F.lit("the "), a))

    def bare(a: Column) -> Column:
        return F.when(_is_number(a), F.concat(F.lit("agent "), a)).otherwise(a)

    one = F.coalesce(F.try_element_at(own, F.get(sorted_agents, F.lit(0))), with_article(F.get(sorted_agents, F.lit(0))))
    two = F.array_join(F.transform(sorted_agents, with_article), " and ")
    listed = F.transform(sorted_agents, bare)
    many = F.concat(
        F.lit("agents "),
        F.array_join(F.slice(listed, F.lit(1), F.greatest(F.size(listed) - 1, F.lit(0))), ", "),
        F.lit(", and "),
        F.element_at(listed, -1),
    )
    n = F.size(sorted_agents)
    return F.when(n == 1, one).when(n == 2, two).when(n >= 3, many)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Put values into ``{name}`` placeholders; a null value leaves its placeholder."""
    out = template
    for name, value in values.items():
        hole = F.lit("{" + name + "}")
        out = F.replace(out, hole, F.coalesce(value, hole))
    return out
