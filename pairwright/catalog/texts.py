"""Statement texts, ids, classes, answers and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog.formulas import ascii_sql, strip_sql
from pairwright.catalog.registry import big, joined, query, sql_joined
from pairwright.catalog.views import (
    CORPUS_SQL, EVENTS_SQL, FORMULAS_SQL, LOG_SQL, PAIRS_SQL, _sql_text, documents, events, sql_list, v_corpus, v_formulas, v_log,
    v_pairs,
)
from pairwright.functions import answers, prompts, rules
from pairwright.functions import formula as fx
from pairwright.functions import identity as ident
from pairwright.functions.text import cut, word_count
from pairwright.operators.enrich import sample_columns
from pairwright.sources.readers import flatten_results


@query(
    "p06_content_ids",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn,
      substring(sha256(lower({strip_sql('nl')}) || '|' || {strip_sql('target')}), 1, 12) AS content_id,
      substring(md5(nl || '|' || target), 1, 12) AS pair_id,
      md5({strip_sql('lower(nl)')}) AS statement_hash,
      substring(md5({strip_sql('lower(nl)')}), 1, 12) AS statement_id FROM v_pairs""",
)
def p06(spark, sf):
    nl, t = F.col("nl"), F.col("target")
    return v_pairs(spark, sf).select(
        "conv_id", "turn", ident.content_id(nl, t).alias("content_id"), ident.pair_id(nl, t).alias("pair_id"),
        ident.statement_hash(nl).alias("statement_hash"), ident.statement_id(nl).alias("statement_id"),
    )


def classify_sql(text: str) -> str:
    names = list(vocab.DOMAIN_WORDS)
    scores = [
        " + ".join(f"CAST(contains({text}, {_sql_text(w)}) AS INTEGER)" for w in vocab.DOMAIN_WORDS[n]) for n in names
    ]
    best = "greatest(" + ", ".join(scores) + ")"
    cases = " ".join(f"WHEN ({s}) = ({best}) THEN '{n}'" for n, s in zip(names, scores))
    return f"CASE WHEN ({best}) = 0 THEN '{vocab.GENERIC_DOMAIN}' {cases} END"


@query(
    "p07_classify",
    f"""WITH {FORMULAS_SQL}, t AS (
      SELECT 'e' || event_id AS id, lower(nl || ' ' || formula) AS text FROM v_formulas
      UNION ALL SELECT 'd' || doc_id, lower(text || ' ' || source) FROM documents)
    SELECT id, {classify_sql('text')} AS domain FROM t""",
)
def p07(spark, sf):
    a = v_formulas(spark, sf).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("nl"), F.col("formula")
    )
    b = documents(spark, sf).select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("nl"), F.col("source").alias("formula")
    )
    return a.unionByName(b).select("id", ident.domain_of(F.col("nl"), F.col("formula")).alias("domain"))


COALITIONS_SQL = f"""{EVENTS_SQL}, c AS (
  SELECT event_id, list_distinct(CASE k % 6 WHEN 0 THEN ['robot'] WHEN 1 THEN [CAST(user_id AS VARCHAR)]
    WHEN 2 THEN [CAST(user_id AS VARCHAR), event_type] WHEN 3 THEN ['probe' || (k % 5)]
    WHEN 4 THEN [CAST(user_id AS VARCHAR), event_type, CAST(k AS VARCHAR)]
    ELSE [event_type, 'b_team', 'a_team', CAST(user_id AS VARCHAR)] END) AS m FROM ev),
s AS (SELECT event_id, list_concat(
    list_sort(list_filter(m, lambda x: NOT regexp_matches(x, '^[0-9]+$'))),
    list_sort(list_filter(m, lambda x: regexp_matches(x, '^[0-9]+$')))) AS m FROM c),
w AS (SELECT event_id, m,
    list_transform(m, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'agent ' || x ELSE 'the ' || x END) AS the,
    list_transform(m, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN 'agent ' || x ELSE x END) AS bare FROM s)"""


def coalitions(spark, sf):
    k = F.pmod("k", F.lit(6))
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    members = (
        F.when(k == 0, F.array(F.lit("robot")))
        .when(k == 1, F.array(user))
        .when(k == 2, F.array(user, kind))
        .when(k == 3, F.array(F.concat(F.lit("probe"), F.pmod("k", F.lit(5)).cast("string"))))
        .when(k == 4, F.array(user, kind, F.col("k").cast("string")))
        .otherwise(F.array(kind, F.lit("b_team"), F.lit("a_team"), user))
    )
    return events(spark, sf).withColumn("m", members)


@query(
    "p11_coalition_text",
    f"""WITH {COALITIONS_SQL} SELECT event_id, CASE
      WHEN len(m) = 1 THEN CASE WHEN m[1] = 'robot' THEN 'the robot' ELSE the[1] END
      WHEN len(m) = 2 THEN the[1] || ' and ' || the[2]
      ELSE 'agents ' || array_to_string(bare[1:len(bare) - 1], ', ') || ', and ' || bare[len(bare)] END AS phrase FROM w""",
)
def p11(spark, sf):
    return coalitions(spark, sf).select("event_id", fx.coalition_text(F.col("m")).alias("phrase"))


@query(
    "p12_instantiate",
    f"""WITH {EVENTS_SQL} SELECT event_id,
      replace(replace(replace(({sql_list([s for _, _, s in vocab.FORMULA_SHAPES])})[CAST(event_id % 20 AS INTEGER) + 1],
        '{{coalition}}', 'user_' || user_id), '{{p}}', event_type), '{{q}}', 'code_' || k) AS formula FROM ev""",
)
def p12(spark, sf):
    shapes = F.array(*[F.lit(s) for _, _, s in vocab.FORMULA_SHAPES])
    return events(spark, sf).select(
        "event_id",
        fx.fill(
            F.get(shapes, F.pmod("event_id", F.lit(20)).cast("int")),
            {
                "coalition": F.concat(F.lit("user_"), F.col("user_id").cast("string")), "p": F.col("event_type"),
                "q": F.concat(F.lit("code_"), F.col("k").cast("string")), "r": F.lit(None).cast("string"),
            },
        ).alias("formula"),
    )


@query(
    "p13_enrich",
    f"""WITH {FORMULAS_SQL}, a AS (SELECT *, {ascii_sql('formula')} AS f, k % 3 <> 0 AS ok FROM v_formulas)
    SELECT event_id, substring(sha256(lower({strip_sql('nl')}) || '|' || {strip_sql('f')}), 1, 12) AS id, f AS atl_formula,
      {classify_sql("lower(nl || ' ' || formula)")} AS domain, template_id, ok AS syntax_valid,
      CASE WHEN ok THEN 1.0::DOUBLE END AS confidence, 'mock' AS provider FROM a""",
)
def p13(spark, sf):
    ok = F.pmod("k", F.lit(3)) != 0
    rows = v_formulas(spark, sf).select(
        "event_id",
        *sample_columns(F.col("nl"), F.col("formula"), F.col("template_id"), F.lit("mock"), critique_ok=ok),
    )
    return rows.select(
        "event_id", "id", "atl_formula", "domain", "template_id", "syntax_valid", "confidence",
        F.col("generation.provider").alias("provider"),
    )


@query(
    "p15_chat_records",
    f"""WITH {CORPUS_SQL} SELECT doc_id, 'system' AS first_role, {_sql_text(vocab.TRAINING_REQUEST)} || chr(10) || chr(10) || nl_statement
      || chr(10) || chr(10) || 'Domain: ' || domain
      || CASE WHEN flagged IS NULL THEN '' ELSE chr(10) || chr(10) || 'Agents: ' || source_file || ', ' || domain END AS user_text,
      atl_formula AS assistant_text FROM v_corpus""",
)
def p15(spark, sf):
    agents = F.when(F.col("flagged").isNotNull(), F.array("source_file", "domain"))
    m = prompts.chat_messages(F.col("nl_statement"), F.col("atl_formula"), F.col("domain"), agents)
    return v_corpus(spark, sf).select("doc_id", m.alias("m")).select(
        "doc_id", F.col("m")[0]["role"].alias("first_role"), F.col("m")[1]["content"].alias("user_text"),
        F.col("m")[2]["content"].alias("assistant_text"),
    )


@query(
    "p16_prompts",
    f"""WITH {PAIRS_SQL}, q AS (SELECT conv_id, turn, nl, target FROM v_pairs)
    SELECT conv_id, turn,
      'Judge whether the formula says what the requirement says.' || chr(10) || chr(10) || 'Requirement:' || chr(10) || nl
        || chr(10) || chr(10) || 'Formula:' || chr(10) || target || chr(10) || chr(10)
        || 'Answer with one JSON object with the keys "ok", "issues", "explanation" and "suggested_fix".' AS critique,
      'Translate the following requirement into an ATL formula.' || chr(10) || chr(10) || 'Requirement:' || chr(10) || nl
        || chr(10) || chr(10) || 'Respond with ONLY the ATL formula, nothing else.' AS cross_translation FROM q""",
)
def p16(spark, sf):
    nl, t = F.col("nl"), F.col("target")
    return v_pairs(spark, sf).select(
        "conv_id", "turn", prompts.critique(nl, t).alias("critique"), prompts.cross_translation(nl).alias("cross_translation")
    )


ANSWER_PARTS = [
    "Here it is:\n```atl\n{f}\n```\nNL: {f} is not a line",
    "{f}.;\n# {f}\n- {f}\nplain words",
    "Answer: ATL: none",
    "formula: a U b\nnext a X line;",
]


def answer_texts(spark, sf):
    """Answers with a formula fenced, on lines, labelled or missing."""
    no = F.pmod("k", F.lit(4)).cast("int")
    text = fx.fill(F.get(F.array(*[F.lit(a) for a in ANSWER_PARTS]), no), {"f": F.col("formula")})
    return v_formulas(spark, sf).select("event_id", "k", "formula", text.alias("answer"))


def sql_newlines(s: str) -> str:
    return " || chr(10) || ".join(_sql_text(x) for x in s.split("\n"))


ANSWERS_SQL = f"""{FORMULAS_SQL}, ans AS (SELECT event_id, k, formula,
  replace(CASE k % 4 WHEN 0 THEN {sql_newlines(ANSWER_PARTS[0])} WHEN 1 THEN {sql_newlines(ANSWER_PARTS[1])}
    WHEN 2 THEN {sql_newlines(ANSWER_PARTS[2])} ELSE {sql_newlines(ANSWER_PARTS[3])} END, '{{f}}', formula) AS answer FROM v_formulas)"""


def drop_sql(x: str, prefixes: list[str], ignore_case: bool = False) -> str:
    for p in prefixes:
        x = f"regexp_replace({x}, '{'(?i)' if ignore_case else ''}\\A{p}\\s*', '')"
    return x


CANDIDATES_SQL = f"""{ANSWERS_SQL}, c0 AS (SELECT event_id, {strip_sql('answer')} AS text FROM ans),
c1 AS (SELECT event_id, text, list_concat(
  list_filter(list_transform(regexp_extract_all(text, '(?s)```(?:atl)?\\s*(.*?)\\s*```', 1), lambda x: {strip_sql('x')}), lambda x: x <> ''),
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}),
    lambda x: starts_with(x, '⟨⟨') OR starts_with(x, '<<') OR (x <> '' AND NOT regexp_matches(x, '^(#|//|NL:|ATL:|-|\\*)')
      AND (contains(x, '⟨⟨') OR contains(x, '<<') OR contains(x, 'G ') OR contains(x, 'F ') OR contains(x, 'X ') OR contains(x, ' U '))))) AS found FROM c0),
cand AS (SELECT event_id, list_filter(list_transform(
   CASE WHEN len(found) > 0 THEN found ELSE [{drop_sql('text', vocab.ANSWER_PREFIXES, True)}] END,
   lambda x: regexp_replace(x, '[.,;:]+\\z', '')), lambda x: x <> '') AS found FROM c1)"""


@query("p17_candidates", f"WITH {CANDIDATES_SQL} SELECT event_id, {sql_joined('found', ' || ')} AS candidates FROM cand")
def p17(spark, sf):
    return answer_texts(spark, sf).select(
        "event_id", joined(answers.formula_candidates(F.col("answer")), " || ").alias("candidates")
    )


PARTS = f"list_transform(string_split(t1, '```'), lambda x: {strip_sql('x')})"


@query(
    "p18_clean_answer",
    f"""WITH {ANSWERS_SQL}, s AS (SELECT event_id, {strip_sql('answer')} AS t FROM ans),
    s1 AS (SELECT *, CASE WHEN len(string_split(t, ':')) = 2 THEN {strip_sql("string_split(t, ':')[2]")} ELSE t END AS t1,
      CASE WHEN contains(t, ':') THEN {strip_sql("regexp_replace(t, '(?s)\\A[^:]*:', '')")} ELSE t END AS t2,
      {strip_sql("regexp_replace(" + strip_sql("regexp_replace(t, '\\A```\\w*\\n?', '')") + ", '\\n?```\\z', '')")} AS t5 FROM s)
    SELECT event_id, {drop_sql('t', vocab.SHORT_ANSWER_PREFIXES)} AS by_prefixes,
      CASE WHEN contains(t1, '```') THEN coalesce(list_filter({PARTS}, lambda x: x <> '' AND NOT starts_with(x, 'atl'))[1], t1) ELSE t1 END AS by_single_colon,
      CASE WHEN contains(t2, '```') THEN {strip_sql("string_split(t2, '```')[2]")} ELSE t2 END AS by_first_colon,
      {drop_sql(strip_sql("array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT starts_with(" + strip_sql('x') + ", '```')), chr(10))"), vocab.FENCED_ANSWER_PREFIXES)} AS by_fence_lines,
      CASE WHEN contains(t5, '<<') AND contains(t5, '>>') THEN t5 END AS by_fence_edges FROM s1""",
)
def p18(spark, sf):
    modes = ["prefixes", "single_colon", "first_colon", "fence_lines", "fence_edges"]
    return answer_texts(spark, sf).select(
        "event_id", *[answers.clean_answer(F.col("answer"), m).alias(f"by_{m}") for m in modes]
    )


def numbered(spark, sf):
    """Documents whose lines carry list marks of three kinds."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda ln, i: F.when(F.pmod(i, F.lit(3)) == 0, F.concat((i + 1).cast("string"), F.lit(". "), ln))
        .when(F.pmod(i, F.lit(3)) == 1, F.concat(F.lit("- "), ln))
        .otherwise(F.concat((i + 1).cast("string"), F.lit("G "), ln)),
    )
    return documents(spark, sf).select("doc_id", F.array_join(lines, "\n").alias("answer"))


NUMBERED_SQL = """n0 AS (SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE (i - 1) % 3 WHEN 0 THEN i || '. ' || x WHEN 1 THEN '- ' || x ELSE i || 'G ' || x END), chr(10)) AS answer FROM documents)"""


@query(
    "p19_list_items",
    f"""WITH {NUMBERED_SQL}, i0 AS (SELECT doc_id, list_filter(list_transform(string_split({strip_sql('answer')}, chr(10)), lambda x:
        regexp_replace(regexp_replace({strip_sql('x')}, '^[0-9]+[.):\\-]\\s*', ''), '^[\\-*•]\\s*', '')), lambda x: length(x) > 20) AS items FROM n0)
    SELECT doc_id, CAST(unnest(generate_series(1, len(items))) AS BIGINT) AS item_no, unnest(items) AS item FROM i0""",
)
def p19(spark, sf):
    items = answers.list_items(F.col("answer"), min_length=20, bullets=True)
    return numbered(spark, sf).select("doc_id", F.posexplode(items).alias("i", "item")).select(
        "doc_id", big(F.col("i") + 1).alias("item_no"), "item"
    )


def verdict_texts(spark, sf):
    """Verifier answers: an object in a sentence, a fenced object, broken or none."""
    k = F.col("k")
    word = F.when(F.pmod(k, F.lit(3)) == 0, "accept").when(F.pmod(k, F.lit(3)) == 1, "REJECT").otherwise("needs_review")
    body = F.concat(
        F.lit('{"verdict": "'), word, F.lit('", "confidence": '), (k / F.lit(100.0)).cast("decimal(4,2)").cast("string"),
        F.lit(', "issues": ["code '), k.cast("string"), F.lit('", "'), F.col("event_type"), F.lit('"], "explanation": "seen"}'),
    )
    answer = (
        F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("I cannot say for "), F.col("event_type")))
        .when(F.pmod(k, F.lit(7)) == 1, F.lit('{"verdict": ACCEPT, }'))
        .when(F.pmod(k, F.lit(7)) == 2, F.lit('{"confidence": 0.25}'))
        .otherwise(F.concat(F.lit("My verdict: "), body, F.lit(" - done")))
    )
    return events(spark, sf).select("event_id", "k", "event_type", "user_id", answer.alias("answer"))


VERDICTS_SQL = f"""{EVENTS_SQL}, va AS (SELECT event_id, k, event_type, user_id, CASE k % 7
    WHEN 0 THEN 'I cannot say for ' || event_type WHEN 1 THEN '{{"verdict": ACCEPT, }}' WHEN 2 THEN '{{"confidence": 0.25}}'
    ELSE 'My verdict: {{"verdict": "' || CASE k % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'REJECT' ELSE 'needs_review' END
      || '", "confidence": ' || CAST(CAST(k / 100.0 AS DECIMAL(4,2)) AS VARCHAR) || ', "issues": ["code ' || k || '", "' || event_type
      || '"], "explanation": "seen"}} - done' END AS answer FROM ev),
vj AS (SELECT *, regexp_extract(answer, '\\{{[^{{}}]*\\}}') AS j FROM va),
vd AS (SELECT event_id, k, event_type, user_id, j = '' AS missing, j <> '' AND NOT json_valid(j) AS broken,
    CASE WHEN json_valid(j) THEN j END AS j, answer FROM vj),
verdicts AS (SELECT event_id, k, event_type, user_id,
    CASE WHEN missing OR broken THEN 'REJECT' ELSE upper(coalesce(json_extract_string(j, '$.verdict'), 'REJECT')) END AS verdict,
    CASE WHEN missing OR broken THEN 0.0 ELSE coalesce(CAST(json_extract_string(j, '$.confidence') AS DOUBLE), 0.0) END AS confidence,
    CASE WHEN missing THEN ['Could not parse response'] WHEN broken THEN ['Malformed JSON in response']
      ELSE coalesce(CAST(json_extract(j, '$.issues') AS VARCHAR[]), CAST([] AS VARCHAR[])) END AS issues,
    CASE WHEN missing THEN substring(answer, 1, 200) WHEN broken THEN 'Verification failed'
      ELSE coalesce(json_extract_string(j, '$.explanation'), '') END AS explanation,
    missing OR broken AS parse_failed FROM vd)"""


@query(
    "p20_verdicts",
    f"""WITH {VERDICTS_SQL} SELECT event_id, verdict, confidence, {sql_joined('issues')} AS issues, explanation, parse_failed FROM verdicts""",
)
def p20(spark, sf):
    v = F.col("v")
    return verdict_texts(spark, sf).select("event_id", answers.verdict(F.col("answer")).alias("v")).select(
        "event_id", v["verdict"].alias("verdict"), v["confidence"].alias("confidence"), joined(v["issues"]).alias("issues"),
        v["explanation"].alias("explanation"), v["parse_failed"].alias("parse_failed"),
    )


@query(
    "p22_pair_quality",
    f"""WITH {FORMULAS_SQL}, q AS (SELECT event_id, len(regexp_extract_all(nl, '\\S+')) AS words, k % 7 AS depth,
      starts_with(formula, '<<') OR starts_with(formula, '⟨⟨') AS top FROM v_formulas)
    SELECT event_id, round(least(1.0, CASE WHEN words BETWEEN 5 AND 30 THEN 0.3 WHEN words > 0 THEN 0.1 ELSE 0.0 END + 0.3
      + CASE WHEN depth BETWEEN 1 AND 4 THEN 0.2 WHEN depth > 0 THEN 0.1 ELSE 0.0 END + CASE WHEN top THEN 0.2 ELSE 0.1 END)::DOUBLE, 6) AS score FROM q""",
)
def p22(spark, sf):
    f = F.col("formula")
    top = F.startswith(f, F.lit("<<")) | F.startswith(f, F.lit("⟨⟨"))
    score = rules.pair_quality(word_count(F.col("nl")), F.pmod("k", F.lit(7)), top)
    return v_formulas(spark, sf).select("event_id", F.round(score, 6).alias("score"))


@query(
    "p23_cost",
    f"""WITH {LOG_SQL} SELECT sample_id, round(prompt_tokens / 1000.0::DOUBLE * 0.03::DOUBLE + completion_tokens / 1000.0::DOUBLE * 0.06::DOUBLE, 9) AS cost_usd,
      round(complexity * 200 * 3 / 1000.0::DOUBLE * 0.003::DOUBLE, 9) AS training_usd FROM v_log""",
)
def p23(spark, sf):
    return v_log(spark, sf).select(
        "sample_id",
        F.round(rules.token_cost(F.col("prompt_tokens"), F.col("completion_tokens")), 9).alias("cost_usd"),
        F.round(rules.training_cost(F.col("complexity")), 9).alias("training_usd"),
    )


@query(
    "p24_reason_keys",
    """SELECT substring(text, 1, 60) AS short_key, substring(text, 1, 100) AS long_key, count(*) AS n
    FROM documents GROUP BY 1, 2""",
)
def p24(spark, sf):
    t = F.col("text")
    return (
        documents(spark, sf).groupBy(cut(t, 60).alias("short_key"), cut(t, 100).alias("long_key")).agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "p25_lengths",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, CAST(length(text) AS BIGINT) AS chars FROM documents""",
)
def p25(spark, sf):
    return documents(spark, sf).select(
        "doc_id", big(word_count(F.col("text"))).alias("words"), big(F.length("text")).alias("chars")
    )


@query(
    "p26_flatten_results",
    f"""WITH {FORMULAS_SQL} SELECT 's' || event_id AS sample_id, 'unknown' AS domain, k % 4 <> 0 AS syntax_valid,
      CASE WHEN k % 4 <> 0 THEN k % 3 = 0 END AS semantic_verified,
      CASE WHEN k % 4 <> 0 THEN CAST(k AS DOUBLE) / 100 ELSE 0.0::DOUBLE END AS confidence,
      CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS cross_model_agreement,
      CAST(len(regexp_extract_all(formula, '\\S+')) AS BIGINT) AS complexity, CAST(k AS DOUBLE) AS latency_ms FROM v_formulas""",
)
def p26(spark, sf):
    k = F.col("k")
    valid = F.pmod(k, F.lit(4)) != 0
    nested = v_formulas(spark, sf).select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("sample_id"),
        F.col("formula").alias("original_atl"),
        F.struct(valid.alias("valid")).alias("syntax_check"),
        F.when(
            valid, F.struct((F.pmod(k, F.lit(3)) == 0).alias("matches"), (k.cast("double") / 100).alias("confidence"))
        ).alias("semantic_check"),
        F.when(F.pmod(k, F.lit(5)) != 0, F.pmod(k, F.lit(2)) == 0).alias("cross_model_agreement"),
        k.cast("double").alias("verification_time_ms"),
    )
    flat = flatten_results(nested).drop("prompt_tokens", "completion_tokens")
    return flat.withColumn("complexity", big(F.col("complexity")))


GUIDANCE_SQL = " ".join(f"WHEN {i} THEN {_sql_text('Pattern focus: ' + t)}" for i, t in enumerate(vocab.PATTERN_GUIDANCE.values()))


@query(
    "p16_statement_prompts",
    f"""WITH {EVENTS_SQL} SELECT event_id, 'Write requirements about what agents can achieve or guarantee over time.' || chr(10) || chr(10) || 'Domain: ' || event_type
      || chr(10) || 'Typical agents: user_' || user_id || ', service' || chr(10) || 'Typical propositions: '
      || array_to_string(list_transform(generate_series(1, least(8, k % 12 + 1)), lambda i: 'p' || i), ', ')
      || CASE WHEN k % 6 < 5 THEN chr(10) || chr(10) || CASE k % 6 {GUIDANCE_SQL} END ELSE '' END
      || chr(10) || chr(10) || 'Write 4 different requirements, one per line, numbered 1-4. No formulas.' AS prompt,
      'Write the requirement below as one ATL formula.' || chr(10) || chr(10) || 'Be short.' || chr(10) || chr(10)
      || 'Output ONLY the ATL formula, nothing else.' || chr(10) || 'NL: ' || event_type || chr(10) || 'ATL:' AS translation FROM ev""",
)
def p16s(spark, sf):
    k, names = F.col("k"), list(vocab.PATTERN_GUIDANCE)
    pattern = F.get(F.array(*[F.lit(n) for n in names]), F.pmod(k, F.lit(6)))
    atoms = F.transform(F.sequence(F.lit(1), F.pmod(k, F.lit(12)) + 1), lambda i: F.concat(F.lit("p"), i.cast("string")))
    agents = F.array(F.concat(F.lit("user_"), F.col("user_id").cast("string")), F.lit("service"))
    return events(spark, sf).select(
        "event_id", prompts.statements(F.col("event_type"), agents, atoms, pattern, 4, examples=[], max_atoms=8).alias("prompt"),
        prompts.translation(F.col("event_type"), examples=[], instructions="Be short.").alias("translation"),
    )
