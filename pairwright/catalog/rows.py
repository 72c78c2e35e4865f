"""Filters, routing, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog.formulas import PROFILE_SQL, ASCII, errors_sql, strip_sql
from pairwright.catalog import replies
from pairwright.catalog.registry import big, joined, query, sql_joined
from pairwright.catalog.texts import CANDIDATES_SQL, VERDICTS_SQL, answer_texts, verdict_texts
from pairwright.catalog.views import (
    CORPUS_SQL, EVENTS_SQL, FORMULAS_SQL, LOG_SQL, PAIRS_SQL, RESULTS_SQL, _sql_text, events, sql_list, table, v_corpus, v_formulas,
    v_log, v_pairs, v_results,
)
from pairwright.functions import answers, rules
from pairwright.functions import formula as fx
from pairwright.operators import changes, identity
from pairwright.operators.generate import with_paraphrases
from pairwright.operators.stats import histograms
from pairwright.plans import compare, create, training, verify
from pairwright.sources import dimensions


@query("f01_by_domain_and_id", f"WITH {CORPUS_SQL} SELECT doc_id, source_file, n_chars FROM v_corpus WHERE domain = 'fr' OR doc_id = 7")
def f01(spark, sf):
    return v_corpus(spark, sf).filter((F.col("domain") == "fr") | (F.col("doc_id") == 7)).select("doc_id", "source_file", "n_chars")


@query("f02_unverified", f"WITH {CORPUS_SQL} SELECT doc_id, domain FROM v_corpus WHERE syntax_valid IS NULL")
def f02(spark, sf):
    return v_corpus(spark, sf).filter(F.col("syntax_valid").isNull()).select("doc_id", "domain")


CASCADE = """CASE WHEN coalesce(CAST(verification_confidence AS DOUBLE), 1.0) < 0.6 THEN 'filtered_confidence'
  WHEN coalesce(verification_status, 'verified') <> 'verified' THEN 'filtered_status'
  WHEN coalesce(domain, '') NOT IN ('click', 'view', 'signup') THEN 'filtered_domain' END"""
FIELDS = """CASE WHEN nl_statement IS NULL THEN 'Missing required field: nl_statement' WHEN nl_statement = '' THEN 'Invalid value for field: nl_statement'
  WHEN atl_formula IS NULL THEN 'Missing required field: atl_formula' WHEN atl_formula = '' THEN 'Invalid value for field: atl_formula'
  WHEN length(nl_statement) < 10 THEN 'NL statement too short' WHEN length(atl_formula) < 3 THEN 'ATL formula too short' END"""


def marked(spark, sf):
    return training.mark_rows(v_results(spark, sf), 0.6, "verified", ["click", "view", "signup"])


@query(
    "f03_filter_cascade",
    f"WITH {RESULTS_SQL} SELECT coalesce({CASCADE}, 'passed') AS outcome, count(*) AS n FROM v_results GROUP BY 1",
)
def f03(spark, sf):
    return training.filter_counts(marked(spark, sf))


@query("f04_field_errors", f"WITH {RESULTS_SQL} SELECT id, {FIELDS} AS field_error FROM v_results")
def f04(spark, sf):
    return marked(spark, sf).select("id", "field_error")


@query(
    "f05_non_empty_pairs",
    f"""WITH {RESULTS_SQL}, p AS (SELECT id, {strip_sql('atl_formula')} AS f FROM v_results) SELECT id, f FROM p WHERE f <> ''""",
)
def f05(spark, sf):
    from pairwright.functions.text import strip

    rows = v_results(spark, sf).select("id", strip(F.col("atl_formula")).alias("f"))
    return rows.filter(F.col("f") != "")


F09 = f"{ASCII}, e AS (SELECT event_id, f, {errors_sql('f', 'boundary', False)} AS errors FROM a)"


@query(
    "f09_auto_reject",
    f"""WITH {F09} SELECT event_id, len(errors) = 0 AS syntax_valid,
      CASE WHEN len(errors) > 0 THEN 'rejected' END AS verification_status, CASE WHEN len(errors) > 0 THEN 'syntax_check' END AS verifier,
      CASE WHEN len(errors) > 0 THEN {sql_joined('errors')} END AS reasons,
      CASE WHEN len(errors) > 0 THEN {_sql_text(vocab.NOTE_AUTO_REJECTED)} END AS notes FROM e""",
)
def f09(spark, sf):
    rows = v_formulas(spark, sf).select("event_id", fx.to_ascii(F.col("formula")).alias("atl_formula"))
    errors = rules.formula_errors(F.col("atl_formula"), "boundary", False)
    rows = rows.withColumn("syntax_errors", errors).withColumn("syntax_valid", F.size("syntax_errors") == 0)
    return verify.auto_reject(rows).select(
        "event_id", "syntax_valid", "verification_status", "verifier", F.array_join("rejection_reasons", "|").alias("reasons"),
        F.array_join("verification_notes", "|").alias("notes"),
    )


@query(
    "f10_status_by_confidence",
    f"""WITH {LOG_SQL} SELECT sample_id, CASE WHEN NOT syntax_valid THEN 'rejected' WHEN error IS NOT NULL THEN 'error'
      WHEN coalesce(semantic_verified, false) AND confidence >= 0.7 AND NOT coalesce(cross_model_agreement, true) THEN 'needs_review'
      WHEN coalesce(semantic_verified, false) AND confidence >= 0.7 THEN 'verified'
      WHEN confidence < 0.5 THEN 'rejected' ELSE 'needs_review' END AS status FROM v_log""",
)
def f10(spark, sf):
    status = rules.status_by_confidence(
        F.col("syntax_valid"), F.col("semantic_verified"), F.col("confidence").cast("double"), F.col("cross_model_agreement"),
        F.col("error").isNotNull(),
    )
    return v_log(spark, sf).select("sample_id", status.alias("status"))


@query(
    "f11_status_by_verdict",
    f"""WITH {VERDICTS_SQL} SELECT event_id, CASE verdict WHEN 'ACCEPT' THEN 'verified' WHEN 'REJECT' THEN 'rejected' ELSE 'needs_review' END AS status,
      CASE verdict WHEN 'ACCEPT' THEN 'verified' ELSE 'rejected' END AS status_accept_only,
      CASE WHEN verdict = 'REJECT' THEN {sql_joined('issues')} ELSE '' END AS reasons FROM verdicts""",
)
def f11(spark, sf):
    v = F.col("v")
    rows = verdict_texts(spark, sf).select("event_id", answers.verdict(F.col("answer")).alias("v"))
    return rows.select(
        "event_id", rules.status_by_verdict(v["verdict"]).alias("status"),
        rules.status_accept_only(v["verdict"]).alias("status_accept_only"),
        F.when(v["verdict"] == "REJECT", joined(v["issues"])).otherwise("").alias("reasons"),
    )


RETRYABLE = "(" + " OR ".join(f"contains(t, {_sql_text(x.lower())})" for x in vocab.RETRYABLE_TEXTS) + ")"


@query(
    "f12_retryable",
    f"""WITH {RESULTS_SQL}, t AS (SELECT id, lower(array_to_string(list_concat(coalesce(rejection_reasons, CAST([] AS VARCHAR[])), verification_notes), ' ')) AS t FROM v_results)
    SELECT id, {RETRYABLE} AS retryable FROM t""",
)
def f12(spark, sf):
    return v_results(spark, sf).select(
        "id", rules.is_retryable(F.col("rejection_reasons"), F.col("verification_notes")).alias("retryable")
    )


@query(
    "f13_critique_outcome",
    f"""WITH {FORMULAS_SQL}, o AS (SELECT event_id, CASE WHEN k % 5 = 4 THEN 'unchecked' WHEN k % 5 = 0 THEN 'keep'
        WHEN k % 5 = 1 THEN 'fixed' ELSE 'drop' END AS outcome, event_type, {strip_sql('formula')} AS f FROM v_formulas)
    SELECT event_id, outcome, CASE WHEN outcome = 'fixed' THEN '<<fixed>> G (!' || event_type || ')' ELSE f END AS atl_formula,
      outcome <> 'unchecked' AS syntax_valid, CASE outcome WHEN 'keep' THEN 1.0::DOUBLE WHEN 'fixed' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
      CASE outcome WHEN 'fixed' THEN {_sql_text(vocab.NOTE_FIXED)} WHEN 'unchecked' THEN 'Critique error: Error code: 503' ELSE '' END AS notes
    FROM o WHERE outcome <> 'drop'""",
)
def f13(spark, sf):
    from pairwright.functions.text import strip

    k = F.pmod("k", F.lit(5))
    fix = F.concat(F.lit('{"ok": false, "issues": ["x"], "explanation": "", "suggested_fix": "⟨⟨fixed⟩⟩ G (¬'), F.col("event_type"), F.lit(')"}'))
    answer = (
        F.when(k == 0, F.lit('{"ok": true, "issues": [], "explanation": "", "suggested_fix": null}'))
        .when(k == 1, F.concat(F.lit("```json\n"), fix, F.lit("\n```")))
        .when(k == 2, F.lit('{"ok": false, "issues": ["x"], "explanation": "", "suggested_fix": "no formula"}'))
        .when(k == 3, F.lit("no object"))
    )
    rows = v_formulas(spark, sf).select(
        "event_id", F.col("nl").alias("nl_statement"), strip(F.col("formula")).alias("atl_formula"), answer.alias("answer"),
        F.when(k == 4, "Error code: 503").alias("err"),
    )
    out = verify.apply_critique(rows, F.col("answer"), F.col("err"))
    return out.select(
        "event_id", "outcome", "atl_formula", "syntax_valid", "confidence", joined(F.col("verification_notes")).alias("notes")
    )


@query(
    "f15_valid_candidates",
    f"""WITH {CANDIDATES_SQL}, {PROFILE_SQL.removeprefix(FORMULAS_SQL).lstrip(', ')}, u AS (SELECT event_id, unnest(found) AS x, unnest(range(len(found))) AS candidate_no FROM cand)
    SELECT u.event_id, candidate_no::INTEGER AS candidate_no, x AS atl_formula, CASE WHEN x = 'none' THEN 0 ELSE depth END::INTEGER AS depth
    FROM u JOIN pr USING (event_id) JOIN v_formulas f USING (event_id) WHERE x = 'none' OR valid AND x = {strip_sql('f.formula')}""",
)
def f15(spark, sf):
    found = answer_texts(spark, sf).select(
        "event_id", F.posexplode(answers.formula_candidates(F.col("answer"))).alias("candidate_no", "atl_formula")
    )
    return create.valid_candidates(found).select("event_id", "candidate_no", "atl_formula", F.col("profile.depth").alias("depth"))


# joins -------------------------------------------------------------------------------------------------------------


@query(
    "j01_before_after",
    f"""WITH {RESULTS_SQL}, {VERDICTS_SQL.split('),', 1)[1].lstrip()},
    b AS (SELECT * FROM (SELECT user_id AS id, nl_statement, atl_formula, k <> 40 AND verification_status = 'verified' AS verified,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM v_results) WHERE r = 1),
    a AS (SELECT * FROM (SELECT k AS id, 'G ' || event_type AS atl_formula, CASE WHEN k % 3 = 0 THEN 'F ' || event_type END AS corrected_atl,
        CASE WHEN k % 2 = 0 THEN 'verified' ELSE 'rejected' END AS status, explanation,
        row_number() OVER (PARTITION BY k ORDER BY event_id DESC) AS r FROM verdicts) WHERE r = 1)
    SELECT b.id, b.atl_formula AS before_atl, coalesce(corrected_atl, a.atl_formula) AS after_atl, explanation AS reason,
      corrected_atl IS NOT NULL AND b.atl_formula IS DISTINCT FROM coalesce(corrected_atl, a.atl_formula) AS is_correction,
      verified IS DISTINCT FROM (status = 'verified') AS is_status_change,
      CASE WHEN verified THEN 'verified' ELSE 'unverified' END AS before_status, status AS after_status
    FROM b JOIN a ON b.id = a.id""",
)
def j01(spark, sf):
    before = v_results(spark, sf).select(
        F.col("user_id").alias("id"), "nl_statement", "atl_formula",
        ((F.col("k") != 40) & (F.col("verification_status") == "verified")).alias("verified"), "event_id",
    )
    k = F.col("k")
    after = verdict_texts(spark, sf).select(
        k.cast("bigint").alias("id"), F.concat(F.lit("G "), F.col("event_type")).alias("atl_formula"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("F "), F.col("event_type"))).alias("corrected_atl"),
        F.when(F.pmod(k, F.lit(2)) == 0, "verified").otherwise("rejected").alias("status"),
        answers.verdict(F.col("answer"))["explanation"].alias("explanation"), "event_id",
    )
    return changes.before_after(before, after, F.col("event_id"), F.col("event_id")).drop("nl_statement")


DOMAIN_SQL = """dims AS (SELECT lang AS domain, count(DISTINCT source) AS n_agents, min(source) AS first_agent FROM documents GROUP BY 1)"""


@query(
    "j02_attach_domain",
    f"""WITH {DOMAIN_SQL} SELECT doc_id, d.lang AS domain, n_agents, first_agent FROM documents d LEFT JOIN dims ON dims.domain = d.lang""",
)
def j02(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("domain"), "source")
    dims = docs.groupBy("domain").agg(F.count_distinct("source").alias("n_agents"), F.min("source").alias("first_agent"))
    return dimensions.attach_domain(docs.drop("source"), dims).select("doc_id", "domain", "n_agents", "first_agent")


@query(
    "j03_statement_by_model",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, m.model, CAST(length(nl) AS BIGINT) AS chars FROM v_pairs,
      (VALUES ('base'), ('tuned'), ('third')) AS m(model)""",
)
def j03(spark, sf):
    return compare.per_model(v_pairs(spark, sf), ["base", "tuned", "third"]).select(
        "conv_id", "turn", "model", big(F.length("nl")).alias("chars")
    )


J05 = f"""{RESULTS_SQL}, t AS (SELECT *, lower(array_to_string(list_concat(coalesce(rejection_reasons, CAST([] AS VARCHAR[])), verification_notes), ' ')) AS t FROM v_results),
  r AS (SELECT id, verification_status, {RETRYABLE} AS retryable, event_type FROM t JOIN events USING (event_id)),
  merged AS (SELECT id, verification_status, false AS retried FROM r WHERE verification_status = 'verified'
    UNION ALL SELECT id, verification_status, false FROM r WHERE verification_status = 'rejected' AND NOT retryable
    UNION ALL SELECT id, CASE WHEN event_type = 'click' THEN 'verified' ELSE 'rejected' END, true FROM r WHERE verification_status = 'rejected' AND retryable)"""


def retried_sets(spark, sf):
    rows = v_results(spark, sf).join(
        table(spark, sf, "events").select("event_id", "event_type"), "event_id"
    )
    good = rows.filter(F.col("verification_status") == "verified")
    bad = rows.filter(F.col("verification_status") == "rejected")
    again = bad.filter(rules.is_retryable(F.col("rejection_reasons"), F.col("verification_notes")))
    again = again.withColumn("verification_status", F.when(F.col("event_type") == "click", "verified").otherwise("rejected"))
    return good, bad, again.withColumn("retry_attempt", F.lit(True))


@query("j05_retry_merge", f"WITH {J05} SELECT * FROM merged")
def j05(spark, sf):
    good, bad, again = retried_sets(spark, sf)
    merged = changes.retry_merge(good, bad, again)
    return merged.select("id", "verification_status", F.coalesce("retry_attempt", F.lit(False)).alias("retried"))


@query(
    "j06_update_present",
    f"""WITH {CORPUS_SQL}, {EVENTS_SQL},
      u AS (SELECT * FROM (SELECT user_id AS doc_id, event_type AS domain, k AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM ev) WHERE r = 1)
    SELECT c.doc_id, coalesce(u.domain, c.domain) AS domain, CAST(coalesce(u.n, c.n_chars) AS BIGINT) AS n
    FROM v_corpus c LEFT JOIN u ON c.doc_id = u.doc_id""",
)
def j06(spark, sf):
    store = v_corpus(spark, sf).select("doc_id", "domain", F.col("n_chars").alias("n"))
    updates = events(spark, sf).select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("domain"), big(F.col("k")).alias("n"), "event_id")
    return identity.update_present(store, updates, "doc_id", F.col("event_id"))


J07 = """st AS (SELECT DISTINCT md5(text) AS id FROM conversations),
  b AS (SELECT md5(text) AS id, doc_id FROM documents UNION ALL SELECT md5(text), conv_id * 1000 + turn + 1000000000 FROM conversations)"""


def insert_sets(spark, sf):
    conv = table(spark, sf, "conversations")
    store = conv.select(F.md5("text").alias("id")).distinct()
    batch = table(spark, sf, "documents").select(F.md5("text").alias("id"), "doc_id").unionByName(
        conv.select(F.md5("text").alias("id"), (F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("doc_id"))
    )
    return store, batch


@query("j07_insert_absent", f"WITH {J07} SELECT id, min(doc_id) AS doc_id FROM b WHERE id NOT IN (SELECT id FROM st) GROUP BY id")
def j07(spark, sf):
    store, batch = insert_sets(spark, sf)
    return identity.insert_absent(store, batch, "id", F.col("doc_id"))


@query(
    "j07_insert_counts",
    f"""WITH {J07}, n AS (SELECT count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT id FROM st)) AS added, count(*) AS total FROM b)
    SELECT added, total - added AS duplicates FROM n""",
)
def j07b(spark, sf):
    store, batch = insert_sets(spark, sf)
    return identity.insert_counts(store, batch, "id")


@query(
    "j08_present_in_store",
    """SELECT event_id, user_id FROM events WHERE user_id IN (SELECT doc_id FROM labels)""",
)
def j08(spark, sf):
    store = table(spark, sf, "labels").select(F.col("doc_id").alias("user_id"))
    return identity.present_in(table(spark, sf, "events").select("event_id", "user_id"), store, "user_id")


@query(
    "j09_paraphrase_lineage",
    f"""WITH {FORMULAS_SQL}, o AS (SELECT event_id, nl, formula, {replies.paraphrases_sql('nl')} AS items FROM v_formulas)
    SELECT event_id, nl, formula, CAST(NULL AS VARCHAR) AS paraphrase_of FROM o
    UNION ALL SELECT event_id, unnest(items) AS nl, formula, nl AS paraphrase_of FROM o""",
)
def j09(spark, sf):
    from pairwright.functions import prompts

    rows = v_formulas(spark, sf).select("event_id", "nl", "formula")
    reply = replies.paraphrases(prompts.paraphrase(F.col("nl")))
    items = answers.list_items(reply, original=F.col("nl"), first=3)
    return with_paraphrases(rows.withColumn("items", items), "items")


# dimensions and sets -----------------------------------------------------------------------------------------------


@query(
    "s10_dimension_override",
    """WITH base AS (SELECT DISTINCT source AS domain, lang AS agent FROM documents),
      o AS (SELECT DISTINCT d.source AS domain, 'label_' || l.quality || l.toxic AS agent FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)
    SELECT domain, agent FROM base WHERE domain NOT IN (SELECT domain FROM o) UNION ALL SELECT domain, agent FROM o""",
)
def s10(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    base = d.select(F.col("source").alias("domain"), F.col("lang").alias("agent")).distinct()
    own = F.concat(F.lit("label_"), F.col("quality").cast("string"), F.col("toxic").cast("string"))
    over = d.join(lab.filter("toxic = 1"), "doc_id").select(F.col("source").alias("domain"), own.alias("agent")).distinct()
    return dimensions.merged_domains(base, over)


@query(
    "u01_concatenate",
    """SELECT 'documents' AS source, lang AS domain, text AS nl_statement FROM documents
    UNION ALL SELECT 'conversations', NULL, text FROM conversations UNION ALL SELECT 'benchmark', NULL, text FROM benchmark""",
)
def u01(spark, sf):
    def part(name, *cols):
        return table(spark, sf, name).select(F.lit(name).alias("source"), *cols, F.col("text").alias("nl_statement"))

    docs = part("documents", F.col("lang").alias("domain"))
    return docs.unionByName(part("conversations"), allowMissingColumns=True).unionByName(part("benchmark"), allowMissingColumns=True)


EXPECTED = ["G", "F", "X", "U", "->"]


@query(
    "u02_operator_coverage",
    f"""WITH {ASCII}, o AS (SELECT DISTINCT unnest(list_filter([{', '.join(f"CASE WHEN contains(f, {_sql_text(x)}) THEN {_sql_text(x)} END" for x in ['G', 'F', 'X', 'U', 'W', 'R', '&', '|', '->', '!'])}], lambda x: x IS NOT NULL)) AS op FROM a)
    SELECT op FROM o INTERSECT SELECT unnest({sql_list(EXPECTED)})""",
)
def u02(spark, sf):
    ops = fx.operators(fx.to_ascii(F.col("formula")), "substring")
    seen = histograms(v_formulas(spark, sf), {}, {"op": ops}).select(F.col("value").alias("op"))
    return seen.filter(F.col("op").isin(EXPECTED))


@query(
    "u03_unknown_agents",
    f"""WITH {ASCII}, known AS (SELECT DISTINCT 'user_' || doc_id AS agent FROM labels),
    g AS (SELECT event_id, unnest(list_transform(string_split(regexp_extract(f, '<<([^>]+)>>', 1), ','), lambda x: {strip_sql('x')})) AS agent FROM a)
    SELECT event_id, agent FROM g WHERE agent <> '' AND agent NOT IN (SELECT agent FROM known)""",
)
def u03(spark, sf):
    known = table(spark, sf, "labels").select(F.concat(F.lit("user_"), F.col("doc_id").cast("string")).alias("agent"))
    used = v_formulas(spark, sf).select("event_id", F.explode(fx.agents(F.col("formula"))).alias("agent"))
    return used.join(known, "agent", "left_anti").select("event_id", "agent")


@query(
    "u04_domain_overlap",
    """WITH tr AS (SELECT source AS domain FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1),
      te AS (SELECT source AS domain FROM documents)
    SELECT domain, 'shared' AS side FROM (SELECT domain FROM tr INTERSECT SELECT domain FROM te)
    UNION ALL SELECT domain, 'only_in_test' FROM (SELECT domain FROM te EXCEPT SELECT domain FROM tr)""",
)
def u04(spark, sf):
    d = table(spark, sf, "documents")
    tr = d.join(table(spark, sf, "labels").filter("toxic = 1"), "doc_id").select(F.col("source").alias("domain"))
    te = d.select(F.col("source").alias("domain"))
    shared = dimensions.shared_domains(tr, te).withColumn("side", F.lit("shared"))
    return shared.unionByName(dimensions.only_in_test(tr, te).withColumn("side", F.lit("only_in_test")))
