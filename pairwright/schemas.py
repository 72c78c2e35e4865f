"""Row types of the stored datasets."""

from pyspark.sql import types as T

_S, _D, _B, _I, _L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()
_SS = T.ArrayType(_S)


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


GENERATION = _row(provider=_S, paraphrase_of=_S)

SAMPLE = _row(
    id=_S, nl_statement=_S, atl_formula=_S, atl_unicode=_S, domain=_S, source_file=_S, template_id=_S,
    agents=_SS, operators=_SS, atoms=_SS, generation=GENERATION, syntax_valid=_B, semantic_verified=_B,
    confidence=_D, verification_notes=_SS, created_at=_S,
)

# Earlier spellings of sample fields; read together with SAMPLE, see sources.readers.unify.
OLD_SPELLINGS = _row(nl=_S, nl_text=_S, atl=_S, source=_S, sample_id=_S)

VERDICT = _row(verdict=_S, confidence=_D, issues=_SS, explanation=_S)
SEMANTIC_CHECK = _row(matches=_B, confidence=_D, explanation=_S, issues=_SS, suggested_fix=_S)
CRITIQUE = _row(ok=_B, issues=_SS, explanation=_S, suggested_fix=_S)

EXPERIMENT = T.StructType(
    SAMPLE.fields
    + _row(
        nl_generator=_S, atl_generator=_S, pattern=_S, syntax_errors=_SS, verifier=_S, verification_verdict=_S,
        verification_confidence=_D, verification_status=_S, rejection_reasons=_SS, verified_at=_S,
        retry_attempt=_B, config_name=_S, generator=_S, timestamp=_S, verification=VERDICT,
    ).fields
)

STATEMENT = _row(sample_id=_S, nl=_S, generator=_S, domain=_S, agents=_SS, error=_S)

METRIC = _row(
    sample_id=_S, domain=_S, syntax_valid=_B, semantic_verified=_B, confidence=_D, cross_model_agreement=_B,
    complexity=_I, latency_ms=_D, prompt_tokens=_L, completion_tokens=_L, timestamp=_S,
)

TRANSLATION = _row(
    atl_formula=_S, response_time=_D, tokens_used=_L, syntax_valid=_B, syntax_errors=_SS, error=_S,
)
COMPARISON = _row(
    sample_id=_S, nl_statement=_S, nl_generator=_S, domain=_S, agents=_SS,
    translations=T.MapType(_S, TRANSLATION), timestamp=_S,
)
REVIEW = T.StructType(COMPARISON.fields + _row(review=T.MapType(_S, _S)).fields)

RETRANSLATION = _row(
    sample_id=_S, nl_statement=_S, domain=_S, agents=_SS, original_atl=_S, original_generator=_S,
    original_rejection_reasons=_SS, finetuned_atl=_S, finetuned_syntax_valid=_B, finetuned_syntax_errors=_SS,
    finetuned_verdict=_S, finetuned_confidence=_D, finetuned_issues=_SS, finetuned_notes=_S, improved=_B,
    status=_S, timestamp=_S,
)

CHAT = _row(messages=T.ArrayType(_row(role=_S, content=_S)))

SHAPE_FILE = _row(id=_S, category=_S, atl_template=_S, nl_templates=_SS, description=_S)
DOMAIN_FILE = _row(agents=_SS, atoms=T.MapType(_S, _S))

INFERENCE = _row(
    text=_S, model=_S, provider=_S, prompt_tokens=_L, completion_tokens=_L, latency_ms=_D, error=_S,
)

PROFILE = _row(
    valid=_B, errors=_SS, warnings=_SS, depth=_I, agents=_SS, atoms=_SS, operators=_SS, symbols=_SS,
    coalitions=_SS, coalition_count=_I, max_coalition_size=_I, top_is_coalition=_B, normalised=_S, ascii=_S,
)
