"""Replies of the registered queries: small functions of what a prompt asks about, each with the same text in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def between(prompt: Column, start: str, end: str) -> Column:
    return F.substring_index(F.substring_index(prompt, start, -1), end, 1)


def formula(prompt: Column) -> Column:
    """A translation that names the length of the requirement."""
    return F.concat(F.lit("⟨⟨1⟩⟩ F said_"), F.char_length(between(prompt, "\nNL: ", "\nATL:")).cast("string"))


def formula_sql(nl: str) -> str:
    return f"('⟨⟨1⟩⟩ F said_' || length({nl}))"


#: What paraphrases put in front of the requirement.
WORDINGS = ("Put otherwise: ", "In short: ", "Once more: ")


def paraphrases(prompt: Column) -> Column:
    """Three numbered lines with the requirement after a few words."""
    nl = between(prompt, "Original: ", "\n\nOne per line")
    lines = "\n".join(f"{k}. {w}\x00" for k, w in enumerate(WORDINGS, 1))
    return F.replace(F.lit(lines), F.lit("\x00"), nl)


def paraphrases_sql(nl: str) -> str:
    return "[" + ", ".join(f"'{w}' || {nl}" for w in WORDINGS) + "]"


def critique(prompt: Column) -> Column:
    """Finds fault with the second wording and has no better formula for it."""
    bad = F.startswith(between(prompt, "Requirement:\n", "\n\nFormula:"), F.lit(WORDINGS[1]))
    return F.when(bad, '{"ok": false, "issues": ["too short"], "suggested_fix": null}').otherwise('{"ok": true, "issues": []}')


class Measure:
    """A backend that says how long a prompt is and how it begins; it fails where the prompt has a given piece."""

    provider = "own"

    def __init__(self, model: str = "measure", fail_on: str | None = None):
        self.model, self.fail_on = model, fail_on

    def answer(self, prompt: str) -> tuple[str, int, int]:
        if self.fail_on and self.fail_on in prompt:
            raise RuntimeError("Error code: 503")
        return f"{self.model} {len(prompt)} {prompt[:12]}", 0, 0
