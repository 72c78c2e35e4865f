"""Structure of a formula as one flat struct column.

Nesting depth needs the bracket structure, which no built-in expression gives.
One Arrow-batched function reads each distinct formula of a batch once; there
is no shuffle, and all statistics on top of it are built-in aggregates.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import schemas

TOKEN = re.compile(r"\s*(⟨⟨|<<|⟩⟩|>>|->|→|[()!¬&∧|∨,⊤⊥]|[A-Za-z0-9_]+)")
SPELLING = {
    "⟨⟨": "<<", "⟩⟩": ">>", "→": "->", "implies": "->", "¬": "!", "not": "!", "∧": "&", "and": "&", "∨": "|",
    "or": "|", "⊤": "true", "True": "true", "⊥": "false", "False": "false",
}
PRINTED = {"->": "→", "!": "¬", "&": "∧", "|": "∨", "U": "U", "true": "⊤", "false": "⊥"}
BINDING = {"->": 1, "|": 2, "&": 3, "U": 4}


class FormulaReader:
    """Reads one formula; a subformula is (kind, depth, printed form, ASCII form).

    Precedence from loose to tight: implication, or, and, until, not. A
    temporal letter takes everything up to the closing bracket, and it only
    counts as a letter when it stands as a word of its own.
    """

    def __init__(self, text: str):
        self.words, self.at = [], 0
        pos, end = 0, len(text.rstrip())
        while pos < end:
            m = TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"unexpected text at {pos}")
            self.words.append(SPELLING.get(m[1], m[1]))
            pos = m.end()
        self.atoms, self.coalitions, self.symbols = set(), [], []

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self, wanted: str | None = None) -> str:
        word = self.peek()
        if word is None or (wanted and word != wanted):
            raise ValueError(f"expected {wanted or 'a formula'} at word {self.at + 1}, found {word or 'the end'}")
        self.at += 1
        return word

    def whole(self):
        out = self.run(self.binary(1))
        if self.peek() is not None:
            raise ValueError(f"unexpected {self.peek()} at word {self.at + 1}")
        return out

    def run(self, step):
        """Runs a reading step; steps that it yields run first and their result goes back in. No Python stack limits the nesting."""
        steps, out = [step], None
        while steps:
            try:
                steps.append(steps[-1].send(out))
                out = None
            except StopIteration as done:
                steps.pop()
                out = done.value
        return out

    def binary(self, floor: int):
        left = yield self.single()
        while BINDING.get(self.peek(), 0) >= floor:
            op = self.take()
            self.symbols.append(PRINTED[op])
            right = yield self.binary(BINDING[op] + 1)
            depth = max(left[1], right[1]) + (op == "U")
            left = (op, depth, f"({left[2]} {PRINTED[op]} {right[2]})", f"({left[3]} {op} {right[3]})")
        return left

    def single(self):
        word = self.take()
        if word == "!":
            self.symbols.append("¬")
            kind, depth, shown, plain = yield self.single()
            if kind in ("->", "|", "&"):
                shown, plain = f"({shown})", f"({plain})"
            return "!", depth, "¬" + shown, "!" + plain
        if word == "<<":
            return (yield self.coalition())
        if word in ("X", "F", "G"):
            return (yield self.temporal(word))
        if word == "(":
            inner = yield self.binary(1)
            self.take(")")
            return inner
        if word in ("true", "false"):
            return "const", 0, PRINTED[word], word
        if not (word[0].isalpha() or word[0] == "_") or word == "U":
            raise ValueError(f"unexpected {word} at word {self.at}")
        self.atoms.add(word)
        return "atom", 0, word, word

    def temporal(self, letter: str):
        self.symbols.append(letter)
        _, depth, shown, plain = yield self.binary(1)
        return "temporal", depth + 1, f"{letter} {shown}", f"{letter} {plain}"

    def coalition(self):
        members = set()
        while self.peek() != ">>":
            if members:
                self.take(",")
            name = self.take()
            if not re.fullmatch(r"\w+", name):
                raise ValueError(f"unexpected {name} in a coalition")
            members.add(name)
        self.take(">>")
        self.coalitions.append(sorted(members))
        self.symbols.append("⟨⟨⟩⟩")
        named = ",".join(sorted(members, key=lambda a: (a.isdigit(), a)))
        if self.peek() in ("X", "F", "G"):
            _, depth, shown, plain = yield self.temporal(self.take())
        else:
            self.take("(")
            _, depth, shown, plain = yield self.binary(1)
            self.take(")")
            depth += 1
        return "coalition", depth, f"⟨⟨{named}⟩⟩ {shown}", f"<<{named}>> {plain}"


def describe(text: str | None, max_depth: int, max_size: int, allow_empty: bool, known: frozenset | None) -> dict:
    empty = {"valid": False, "errors": [], "warnings": []}
    try:
        reader = FormulaReader(text or "")
        kind, depth, shown, plain = reader.whole()
    except ValueError as e:
        return {**empty, "errors": [f"Parse error: {e}"]}
    errors, warnings = [], []
    if depth > max_depth:
        errors.append(f"Nesting depth {depth} exceeds maximum {max_depth}")
    for members in reader.coalitions:
        if not members:
            (warnings if allow_empty else errors).append("Coalition has empty agent set")
        if len(members) > max_size:
            errors.append(f"Coalition size {len(members)} exceeds maximum {max_size}")
        unknown = sorted(set(members) - known) if known is not None else []
        if unknown:
            errors.append("Unknown agents: " + ", ".join(unknown))
    return {
        "valid": not errors,
        "errors": errors,
        "warnings": warnings,
        "depth": depth,
        "agents": sorted({a for c in reader.coalitions for a in c}),
        "atoms": sorted(reader.atoms),
        "operators": [s for s in reader.symbols if s in "GFXU"],
        "symbols": reader.symbols,
        "coalitions": [",".join(c) for c in reader.coalitions],
        "coalition_count": len(reader.coalitions),
        "max_coalition_size": max((len(c) for c in reader.coalitions), default=0),
        "top_is_coalition": kind == "coalition",
        "normalised": shown,
        "ascii": plain,
    }


def formula_profile(
    f: Column,
    max_depth: int = 4,
    max_coalition_size: int = 5,
    allow_empty_coalition: bool = True,
    allowed_agents: list[str] | None = None,
) -> Column:
    """Profile struct of a formula column, see ``schemas.PROFILE``."""
    known = frozenset(allowed_agents) if allowed_agents is not None else None
    names = schemas.PROFILE.names

    def profile(batch: pd.Series) -> pd.DataFrame:
        seen = {v: describe(v, max_depth, max_coalition_size, allow_empty_coalition, known) for v in batch.unique()}
        rows = [seen[v] for v in batch]
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    return F.pandas_udf(profile, schemas.PROFILE)(f)
