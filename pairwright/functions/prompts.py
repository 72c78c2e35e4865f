"""Prompt and training-record columns.

Prompts are plain string columns, so they can be built next to the data, made
distinct and handed to one inference stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import vocab


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _optional(label: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(label), value))


def training_request(nl: Column, domain: Column | None = None, agents: Column | None = None) -> Column:
    """User turn: request, then the domain and the agents where the row has them."""
    out = _join(vocab.TRAINING_REQUEST + "\n\n", nl)
    if domain is not None:
        out = F.concat(out, _optional("\n\nDomain: ", domain))
    if agents is not None:
        out = F.concat(out, _optional("\n\nAgents: ", F.array_join(agents, ", ")))
    return out


def chat_messages(
    nl: Column,
    formula: Column,
    domain: Column | None = None,
    agents: Column | None = None,
    system: str = vocab.TRAINING_SYSTEM,
) -> Column:
    """Training record: system, user and assistant message."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(system)),
        message("user", training_request(nl, domain, agents)),
        message("assistant", formula),
    )


def translation(nl: Column, examples: list[tuple[str, str]] | None = None, instructions: str | None = None) -> Column:
    shown = vocab.EXAMPLE_PAIRS if examples is None else examples
    head = ["Write the requirement below as one ATL formula."]
    if shown:
        head.append("Examples:")
        head += [f"NL: {s}\nATL: {f}" for s, f in shown]
    if instructions:
        head.append(instructions)
    head.append("Output ONLY the ATL formula, nothing else.\nNL: ")
    return _join("\n\n".join(head), nl, "\nATL:")


def critique(nl: Column, formula: Column) -> Column:
    return _join(
        "Judge whether the formula says what the requirement says.\n\nRequirement:\n", nl, "\n\nFormula:\n", formula,
        '\n\nAnswer with one JSON object with the keys "ok", "issues", "explanation" and "suggested_fix".',
    )


def paraphrase(nl: Column, n: int = 3, keep_names: bool = True) -> Column:
    rule = "Keep every agent and proposition name as it is.\n\n" if keep_names else ""
    return _join(
        f"Write {n} paraphrases of the requirement below with the same meaning.\n\n{rule}Original: ", nl,
        f"\n\nOne per line, numbered 1-{n}, without the original.",
    )


def statements(
    domain: Column,
    agents: Column,
    atoms: Column,
    pattern: Column,
    n: int = 5,
    examples: list[tuple[str, str]] | None = None,
    max_atoms: int | None = None,
    max_examples: int | None = None,
) -> Column:
    """Request for n statements of a domain; names all atoms and examples, or the first ``max_..`` of them."""
    guidance = F.lit(None).cast("string")
    for name, text in vocab.PATTERN_GUIDANCE.items():
        guidance = F.when(pattern == name, text).otherwise(guidance)
    shown = (vocab.EXAMPLE_PAIRS if examples is None else examples)[:max_examples]
    style = "\n\nStyle examples:\n" + "\n".join(f"- {s}" for s, _ in shown) if shown else ""
    return F.concat(
        F.lit("Write requirements about what agents can achieve or guarantee over time."),
        _optional("\n\nDomain: ", domain),
        _optional("\nTypical agents: ", F.array_join(agents, ", ")),
        _optional("\nTypical propositions: ", F.array_join(atoms if max_atoms is None else F.slice(atoms, 1, max_atoms), ", ")),
        _optional("\n\nPattern focus: ", guidance),
        F.lit(style + f"\n\nWrite {n} different requirements, one per line, numbered 1-{n}. No formulas."),
    )


def verification(nl: Column, formula: Column, domain: Column | None = None) -> Column:
    out = _join("Does the formula capture the requirement?\n\nRequirement: ", nl, "\n\nFormula: ", formula)
    if domain is not None:
        out = F.concat(out, _optional("\n\nDomain: ", domain))
    return _join(
        out,
        '\n\nAnswer in JSON: {"matches": true or false, "confidence": 0.0 to 1.0, "explanation": "", "issues": [], '
        '"suggested_fix": null}',
    )


def verdict(nl: Column, formula: Column, domain: Column | None = None) -> Column:
    out = _join("Judge the formula against the requirement.\n\nRequirement: ", nl, "\n\nFormula: ", formula)
    if domain is not None:
        out = F.concat(out, _optional("\n\nDomain: ", domain))
    return _join(
        out,
        '\n\nAnswer in JSON: {"verdict": "ACCEPT" or "REJECT", "confidence": 0.0-1.0, "issues": [], "explanation": ""}',
    )


def cross_translation(nl: Column) -> Column:
    return _join(
        "Translate the following requirement into an ATL formula.\n\nRequirement:\n", nl,
        "\n\nRespond with ONLY the ATL formula, nothing else.",
    )
