"""Column -> Column functions that read model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import schemas, vocab
from pairwright.functions.text import contains_any, cut, drop_prefixes, let, strip, strip_short

FENCE = "```"
FLAT_OBJECT = r"\{[^{}]*\}"


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def formula_candidates(answer: Column) -> Column:
    """Formula texts an answer may contain, repeats kept.

    Fenced blocks, then lines that open with a coalition or carry an operator
    mark; the whole answer when there is neither.
    """
    text = strip(answer)
    fenced = F.filter(
        F.transform(F.regexp_extract_all(text, F.lit(r"(?s)```(?:atl)?\s*(.*?)\s*```"), F.lit(1)), strip),
        lambda m: m != "",
    )

    def wanted(line: Column) -> Column:
        opens = F.startswith(line, F.lit("⟨⟨")) | F.startswith(line, F.lit("<<"))
        remark = F.regexp_like(line, F.lit(r"^(#|//|NL:|ATL:|-|\*)"))
        return opens | (~remark & contains_any(line, ["⟨⟨", "<<", "G ", "F ", "X ", " U "]))

    found = F.concat(fenced, F.filter(F.transform(_lines(text), strip), wanted))
    whole = drop_prefixes(text, vocab.ANSWER_PREFIXES, ignore_case=True)
    chosen = let(found, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(whole)))
    return F.filter(F.transform(chosen, lambda m: F.regexp_replace(m, r"[.,;:]+\z", "")), lambda m: m != "")


def clean_answer(answer: Column, mode: str = "prefixes") -> Column:
    """One formula text out of an answer.

    prefixes      drop a leading label
    single_colon  text after the colon when there is exactly one; first fenced piece
    first_colon   text after the first colon; first fenced piece
    fence_lines   drop fence lines, then leading labels
    fence_edges   drop fence marks at both ends; null without << and >>
    """
    return let(strip(answer), lambda text: _clean(text, mode))


def _first_piece(text: Column) -> Column:
    parts = F.transform(F.split(text, FENCE), strip)
    first = F.get(F.filter(parts, lambda p: (p != "") & ~F.startswith(p, F.lit("atl"))), F.lit(0))
    return F.when(F.contains(text, F.lit(FENCE)), F.coalesce(first, text)).otherwise(text)


def _inner_piece(text: Column) -> Column:
    inner = strip(F.get(F.split(text, FENCE), F.lit(1)))
    return F.when(F.contains(text, F.lit(FENCE)), inner).otherwise(text)


def _clean(text: Column, mode: str) -> Column:
    pieces = F.split(text, ":")
    if mode == "prefixes":
        return drop_prefixes(text, vocab.SHORT_ANSWER_PREFIXES)
    if mode == "single_colon":
        return let(F.when(F.size(pieces) == 2, strip(F.get(pieces, F.lit(1)))).otherwise(text), _first_piece)
    if mode == "first_colon":
        after = strip(F.regexp_replace(text, r"(?s)\A[^:]*:", ""))
        return let(F.when(F.size(pieces) > 1, after).otherwise(text), _inner_piece)
    if mode == "fence_lines":
        kept = F.filter(_lines(text), lambda ln: ~F.startswith(strip(ln), F.lit(FENCE)))
        return drop_prefixes(strip(F.array_join(kept, "\n")), vocab.FENCED_ANSWER_PREFIXES)
    if mode == "fence_edges":
        bare = strip(F.regexp_replace(strip(F.regexp_replace(text, r"\A```\w*\n?", "")), r"\n?```\z", ""))
        return let(bare, lambda t: F.when(F.contains(t, F.lit("<<")) & F.contains(t, F.lit(">>")), t))
    raise ValueError(f"unknown mode: {mode}")


def list_items(
    answer: Column,
    min_length: int = 0,
    bullets: bool = False,
    quotes: bool = False,
    bare_numbers: bool = False,
    original: Column | None = None,
    first: int | None = None,
) -> Column:
    """Items of a numbered or bulleted answer, one per line.

    A number is only a list mark when punctuation follows; ``bare_numbers``
    also drops numbers without. ``min_length`` keeps items longer than that.
    """
    # one pattern for the edges of all lines, so that no line is worked on by itself outside of generated code
    blank, dot = r"[^\S\n]", "?" if bare_numbers else ""
    opens = rf"^{blank}*(?:[0-9]+[.):\-]{dot}{blank}*)?"
    if bullets:
        opens += rf"(?:[\-*•]{blank}*)?"
    if quotes:
        opens += "[\"']*"
    ends = rf"{blank}+$" + (rf"|[\"']+{blank}*$" if quotes else "")
    items = F.array_remove(_lines(F.regexp_replace(answer, f"(?md){opens}|{ends}", "")), "")
    if min_length > 0:
        items = F.filter(items, lambda i: F.length(i) > min_length)
    if original is not None:  # nothing is told apart from an original that is null
        items = F.coalesce(F.array_remove(items, original), F.slice(items, 1, 0))
    return items if first is None else F.slice(items, 1, first)


def _parsed(text: Column, row: T.StructType) -> Column:
    """from_json whose ``broken`` field is set when the text is no JSON of this type."""
    wide = T.StructType(row.fields + [T.StructField("broken", T.StringType())])
    return F.from_json(text, wide, {"columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})


def verdict(
    answer: Column,
    default_verdict: str = "REJECT",
    default_confidence: float = 0.0,
    unparsed_confidence: float = 0.0,
) -> Column:
    """struct(verdict, confidence, issues, explanation, parse_failed) from the first flat object in an answer.

    Objects that nest further objects are out of reach of the flat match.
    """
    found = F.regexp_extract(answer, FLAT_OBJECT, 0)
    read = F.struct((found == "").alias("missing"), _parsed(found, schemas.VERDICT).alias("v"))
    return let(read, lambda r: _verdict(r, answer, default_verdict, default_confidence, unparsed_confidence))


def _verdict(
    read: Column, answer: Column, default_verdict: str, default_confidence: float, unparsed_confidence: float
) -> Column:
    missing, v = read["missing"], read["v"]
    broken = ~missing & v["broken"].isNotNull()
    failed = missing | broken
    none = F.array().cast("array<string>")
    return F.struct(
        F.upper(F.when(failed, default_verdict).otherwise(F.coalesce(v["verdict"], F.lit(default_verdict)))).alias(
            "verdict"
        ),
        F.when(missing, F.lit(unparsed_confidence))
        .when(broken, F.lit(0.0))
        .otherwise(F.coalesce(v["confidence"], F.lit(default_confidence)))
        .alias("confidence"),
        F.when(missing, F.array(F.lit("Could not parse response")))
        .when(broken, F.array(F.lit("Malformed JSON in response")))
        .otherwise(F.coalesce(v["issues"], none))
        .alias("issues"),
        F.when(missing, cut(answer, 200))
        .when(broken, F.lit("Verification failed"))
        .otherwise(F.coalesce(v["explanation"], F.lit("")))
        .alias("explanation"),
        failed.alias("parse_failed"),
    )


def _unfenced(answer: Column) -> Column:
    text = strip(answer)
    inner = F.regexp_replace(F.get(F.split(text, FENCE), F.lit(1)), r"\Ajson", "")
    return F.when(F.startswith(text, F.lit(FENCE)), inner).otherwise(text)


def semantic_check(answer: Column) -> Column:
    """struct(matches, confidence, explanation, issues, suggested_fix, parse_failed) from an answer that is one object."""
    return let(_parsed(_unfenced(answer), schemas.SEMANTIC_CHECK), _semantic_check)


def _semantic_check(s: Column) -> Column:
    failed = s.isNull() | s["broken"].isNotNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(failed, False).otherwise(F.coalesce(s["matches"], F.lit(False))).alias("matches"),
        F.when(failed, 0.0).otherwise(F.coalesce(s["confidence"], F.lit(0.0))).alias("confidence"),
        F.when(failed, "Failed to parse verifier response")
        .otherwise(F.coalesce(s["explanation"], F.lit("")))
        .alias("explanation"),
        F.when(failed, F.array(F.lit("JSON parse error"))).otherwise(F.coalesce(s["issues"], none)).alias("issues"),
        F.when(~failed, s["suggested_fix"]).alias("suggested_fix"),
        failed.alias("parse_failed"),
    )


def critique(answer: Column) -> Column:
    """struct(ok, issues, explanation, suggested_fix, parse_failed) from an answer that holds one object."""
    return let(critique_object(answer), lambda c: critique_fields(c, answer))


def critique_object(answer: Column) -> Column:
    """The object of an answer as it stands; a table keeps it as a column and takes ``critique_fields`` from it."""
    text = strip_short(answer)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return _parsed(F.when(F.contains(text, F.lit(FENCE)), fenced).otherwise(text), schemas.CRITIQUE)


def critique_fields(c: Column, answer: Column) -> Column:
    failed = c.isNull() | c["broken"].isNotNull()
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(failed, False).otherwise(F.coalesce(c["ok"], F.lit(False))).alias("ok"),
        F.when(failed, F.array(F.lit("Failed to parse LLM critique response")))
        .otherwise(F.coalesce(c["issues"], none))
        .alias("issues"),
        F.when(failed, answer).otherwise(F.coalesce(c["explanation"], F.lit(""))).alias("explanation"),
        F.when(~failed, c["suggested_fix"]).alias("suggested_fix"),
        failed.alias("parse_failed"),
    )
