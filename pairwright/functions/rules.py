"""Rules over formulas and verdicts: errors as arrays, decisions as CASE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions.text import canonical_set, contains_any, count_of, let, strip, strip_short, strings_present
from pairwright.functions.text import members as listed_members

LEADING_COALITION = r"^(<<|⟨⟨)\s*([^>⟩]*)\s*(>>|⟩⟩)"


def _messages(*checks: tuple[Column, Column | str]) -> Column:
    return strings_present([F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks])


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def check_structure(raw: Column) -> Column:
    """Structural check: struct(valid, errors, warnings, agents, temporal_ops, atoms, depth).

    The feature fields are null when there are errors.
    """
    f = strip_short(raw)
    opened, closed = count_of(f, "("), count_of(f, ")")
    left, right = count_of(f, "<<"), count_of(f, ">>")
    uleft, uright = count_of(f, "⟨⟨"), count_of(f, "⟩⟩")
    leads = F.regexp_like(f, F.lit(LEADING_COALITION))
    members = strip(F.regexp_extract(f, LEADING_COALITION, 2))
    letters = F.regexp_extract_all(f, F.lit(r"\b([GFXU])\b"), F.lit(1))

    errors = _messages(
        (~leads & ~contains_any(f, ["<<", "⟨⟨"]), vocab.MSG_NEEDS_COALITION),
        (opened != closed, _text("Unbalanced parentheses: ", opened, " open, ", closed, " close")),
        (left != right, _text("Unbalanced ASCII coalition brackets: ", left, " << vs ", right, " >>")),
        (uleft != uright, vocab.MSG_UNICODE_BRACKETS),
        (F.regexp_like(f, F.lit(r">>\s*$|⟩⟩\s*$")), vocab.MSG_ENDS_WITH_COALITION),
    )
    warnings = _messages(
        (leads & (members == ""), vocab.MSG_EMPTY_COALITION),
        (F.size(letters) == 0, vocab.MSG_MAYBE_INCOMPLETE),
        (F.regexp_like(f, F.lit(r"[GFX]\s*[GFX]")), vocab.MSG_CONSECUTIVE),
    )
    body = F.regexp_replace(F.regexp_replace(f, r"<<[^>]*>>", ""), r"⟨⟨[^⟩]*⟩⟩", "")
    body = F.regexp_replace(body, r"\b(G|F|X|U|and|or|not|implies|true|false)\b", "")
    body = F.regexp_replace(body, r"[()∧∨¬→&|!>\-]", " ")
    found = canonical_set(F.regexp_extract_all(body, F.lit(r"(?<!\S)[a-zA-Z_]\S*"), F.lit(0)))
    listed = F.array_remove(listed_members(members), "")

    valid = F.size(errors) == 0
    return F.struct(
        valid.alias("valid"),
        errors.alias("errors"),
        warnings.alias("warnings"),
        F.when(valid & leads, listed).alias("agents"),
        F.when(valid, canonical_set(letters)).alias("temporal_ops"),
        F.when(valid, found).alias("atoms"),
        F.when(valid, F.greatest(opened, left + uleft, F.size(letters)).cast("int")).alias("depth"),
    )


def formula_errors(raw: Column, temporal: str = "substring", square: bool = True) -> Column:
    """Quick check as an error array; empty means valid.

    ``temporal`` says whether an operator letter counts anywhere (substring) or
    only as a word (boundary); ``square`` adds the square-bracket balance.
    Written for ASCII coalitions: canonicalise first where others may occur.
    """
    f = strip(raw)
    if temporal == "substring":
        has_op = contains_any(f, list("FGXUWR"))
    elif temporal == "boundary":
        has_op = F.regexp_like(f, F.lit(r"\b[FGXUWR]\b|\b[FGXUWR]\("))
    else:
        raise ValueError(f"unknown mode: {temporal}")
    angles = F.replace(F.replace(f, F.lit("->"), F.lit("")), F.lit("<-"), F.lit(""))
    checks = [
        (~F.regexp_like(f, F.lit(r"<<[^>]+>>")), vocab.MSG_NO_COALITION),
        (~has_op, vocab.MSG_NO_TEMPORAL),
        (count_of(f, "(") != count_of(f, ")"), vocab.MSG_PARENS),
    ]
    if square:
        checks.append((count_of(f, "[") != count_of(f, "]"), vocab.MSG_SQUARE))
    checks.append((count_of(angles, "<") != count_of(angles, ">"), vocab.MSG_ANGLES))
    some = f != ""
    return _messages((~some, vocab.MSG_EMPTY), *[(some & bad, m) for bad, m in checks])


def field_error(nl: Column, formula: Column) -> Column:
    """First reason why a pair cannot be a training row; null when it can."""
    return (
        F.when(nl.isNull(), "Missing required field: nl_statement")
        .when(nl == "", "Invalid value for field: nl_statement")
        .when(formula.isNull(), "Missing required field: atl_formula")
        .when(formula == "", "Invalid value for field: atl_formula")
        .when(F.length(nl) < 10, "NL statement too short")
        .when(F.length(formula) < 3, "ATL formula too short")
    )


def failing_filter(
    confidence: Column,
    status: Column,
    domain: Column,
    min_confidence: float = 0.0,
    wanted_status: str = "verified",
    domains: list[str] | None = None,
) -> Column:
    """Name of the first filter a row fails; null when it passes all of them."""
    out = F.when(F.coalesce(confidence.cast("double"), F.lit(1.0)) < min_confidence, "filtered_confidence")
    if wanted_status != "all":
        out = out.when(F.coalesce(status, F.lit("verified")) != wanted_status, "filtered_status")
    if domains:
        out = out.when(~F.coalesce(domain, F.lit("")).isin(domains), "filtered_domain")
    return out


def status_by_confidence(
    syntax_valid: Column,
    matches: Column,
    confidence: Column,
    agreement: Column,
    failed: Column | None = None,
    threshold: float = 0.7,
) -> Column:
    """Status after rule check, semantic verdict and independent translation."""
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    sure = F.coalesce(matches, F.lit(False)) & (confidence >= threshold)
    return (
        F.when(~syntax_valid, "rejected")
        .when(failed, "error")
        .when(sure & F.coalesce(~agreement, F.lit(False)), "needs_review")
        .when(sure, "verified")
        .when(F.coalesce(confidence, F.lit(0.0)) < 0.5, "rejected")
        .otherwise("needs_review")
    )


def corrected(suggested_fix: Column) -> Column:
    """A suggested fix counts unless it is empty or the word null."""
    return F.when((suggested_fix != "") & (F.lower(suggested_fix) != "null"), suggested_fix)


def status_by_verdict(verdict: Column) -> Column:
    """ACCEPT, REJECT, anything else -> needs_review."""
    v = F.upper(F.coalesce(verdict, F.lit("NEEDS_REVIEW")))
    return F.when(v == "ACCEPT", "verified").when(v == "REJECT", "rejected").otherwise("needs_review")


def status_accept_only(verdict: Column) -> Column:
    """ACCEPT -> verified, anything else -> rejected."""
    v = F.upper(F.coalesce(verdict, F.lit("REJECT")))
    return F.when(v == "ACCEPT", "verified").otherwise("rejected")


def is_retryable(reasons: Column, notes: Column, texts: list[str] | None = None) -> Column:
    """Whether reasons or notes carry the text of a failure worth retrying."""
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce(reasons, empty), F.coalesce(notes, empty))
    wanted = [t.lower() for t in (texts or vocab.RETRYABLE_TEXTS)]
    return let(F.lower(F.array_join(both, " ")), lambda text: contains_any(text, wanted))


def critique_outcome(ok: Column, fix: Column, fix_valid: Column, failed: Column) -> Column:
    """keep / fixed / unchecked / drop."""
    return (
        F.when(F.coalesce(failed, F.lit(False)), "unchecked")
        .when(F.coalesce(ok, F.lit(False)), "keep")
        .when((fix != "") & F.coalesce(fix_valid, F.lit(False)), "fixed")
        .otherwise("drop")
    )


def pair_quality(nl_words: Column, depth: Column, top_is_coalition: Column) -> Column:
    """Score of a valid pair: statement length, validity, depth, leading coalition; at most 1."""
    score = (
        F.when(nl_words.between(5, 30), 0.3).when(nl_words > 0, 0.1).otherwise(0.0)
        + F.lit(0.3)
        + F.when(depth.between(1, 4), 0.2).when(depth > 0, 0.1).otherwise(0.0)
        + F.when(top_is_coalition, 0.2).otherwise(0.1)
    )
    return F.least(F.lit(1.0), score)


def token_cost(
    prompt_tokens: Column,
    completion_tokens: Column,
    prompt_price: float = vocab.PROMPT_PRICE,
    completion_price: float = vocab.COMPLETION_PRICE,
) -> Column:
    return prompt_tokens / F.lit(1000.0) * prompt_price + completion_tokens / F.lit(1000.0) * completion_price


def training_cost(valid_rows: Column, price: float = vocab.TRAINING_PRICE) -> Column:
    tokens = valid_rows * vocab.TRAINING_TOKENS_PER_ROW * vocab.TRAINING_EPOCHS
    return tokens / F.lit(1000.0) * price
