"""Inference stages and the jobs around them, with offline replies; streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog import replies
from pairwright.catalog.formulas import BOUNDARY_OPS, STRUCTURE, _idents, ascii_sql, errors_sql, pattern_sql, strip_sql
from pairwright.catalog.registry import big, joined, query, sql_joined
from pairwright.catalog.rows import RETRYABLE
from pairwright.catalog.texts import classify_sql
from pairwright.catalog.views import (
    FORMULAS_SQL, LOG_SQL, PAIRS_SQL, RESULTS_SQL, events, table, v_formulas, v_pairs, v_results,
)
from pairwright.operators import stats
from pairwright.operators.enrich import sample_columns
from pairwright.operators.inference import batch_stage, expression_stage, recorded_stage
from pairwright.plans import compare, create, verify
from pairwright.session import cut_lineage, run_dir
from pairwright.streaming import jobs, store


@query(
    "i01_batch_inference",
    """SELECT conv_id, turn, CASE WHEN contains(text, 'ou') THEN NULL ELSE 'measure ' || length(text) || ' ' || substr(text, 1, 12) END AS text,
      CASE WHEN contains(text, 'ou') THEN 'Error code: 503' END AS error, 'own' AS provider FROM conversations""",
)
def i01(spark, sf):
    ask = batch_stage(lambda: replies.Measure(fail_on="ou"))
    rows = ask(table(spark, sf, "conversations").withColumnRenamed("text", "q"), "q", "a")
    return rows.select("conv_id", "turn", F.col("a.text").alias("text"), F.col("a.error").alias("error"), F.col("a.provider").alias("provider"))


@query(
    "i01_resumed_inference",
    """WITH first AS (SELECT DISTINCT text AS done FROM conversations WHERE role = 'user' AND NOT contains(text, 'ou'))
    SELECT conv_id, turn, CASE WHEN done IS NULL THEN 'second ' ELSE 'first ' END || length(text) || ' ' || substr(text, 1, 12) AS text, CAST(NULL AS VARCHAR) AS error
    FROM conversations LEFT JOIN first ON text = done""",
)
def i01r(spark, sf):
    """A job asks about some prompts and fails on others; the next one asks what the answer table lacks."""
    rows = table(spark, sf, "conversations").withColumnRenamed("text", "q")
    kept = f"{run_dir(spark, 'i01r')}/answers"
    stages = [batch_stage(lambda name=name, fail_on=fail_on: replies.Measure(name, fail_on), kept=kept, slices=2) for name, fail_on in (("first", "ou"), ("second", None))]
    stages[0](rows.where("role = 'user'"), "q", "a")
    return stages[1](rows, "q", "a").select("conv_id", "turn", F.col("a.text").alias("text"), F.col("a.error").alias("error"))


@query(
    "i02_offline_replies",
    f"""WITH {PAIRS_SQL}, rec AS (SELECT nl, min(target) AS reply FROM v_pairs GROUP BY nl)
    SELECT conv_id, turn, reply, CASE WHEN nl IS NULL THEN 'no recorded answer' END AS error FROM conversations LEFT JOIN rec ON nl = text""",
)
def i02(spark, sf):
    """Every turn is asked; what followed a user's turn is the recorded answer to its text."""
    recorded = v_pairs(spark, sf).groupBy(F.col("nl").alias("prompt")).agg(F.min("target").alias("text"))
    rows = recorded_stage(recorded)(table(spark, sf, "conversations"), "text", "a")
    return rows.select("conv_id", "turn", F.col("a.text").alias("reply"), F.col("a.error").alias("error"))


@query(
    "i03_translate",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, CAST(0 AS BIGINT) AS candidate_no, {replies.formula_sql('nl')} AS atl_formula FROM v_pairs""",
)
def i03(spark, sf):
    rows = v_pairs(spark, sf).select("conv_id", "turn", F.col("nl").alias("nl_statement"))
    found = create.candidates(rows, expression_stage(replies.formula))
    return found.select("conv_id", "turn", big(F.col("candidate_no")).alias("candidate_no"), "atl_formula")


@query(
    "i03_critique_and_paraphrase",
    f"""WITH {FORMULAS_SQL}, a AS (SELECT event_id, nl, {ascii_sql('formula')} AS f FROM v_formulas),
    p AS (SELECT event_id, f, unnest(list_prepend(nl, {replies.paraphrases_sql('nl')})) AS nl_statement FROM a)
    SELECT event_id, nl_statement, f AS atl_formula, 1.0::DOUBLE AS confidence FROM p WHERE NOT starts_with(nl_statement, '{replies.WORDINGS[1]}')""",
)
def i03c(spark, sf):
    from pairwright.functions import formula as fx

    rows = v_formulas(spark, sf).select("event_id", "nl", fx.to_ascii(F.col("formula")).alias("formula"))
    more = create.paraphrase(rows, expression_stage(replies.paraphrases))
    more = more.select("event_id", F.col("nl").alias("nl_statement"), F.col("formula").alias("atl_formula"))
    return verify.critique_pairs(more, expression_stage(replies.critique)).select("event_id", "nl_statement", "atl_formula", "confidence")


@query(
    "i03_translate_with_metrics",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, {replies.formula_sql('nl')} AS formulas, CAST(1 AS BIGINT) AS candidates_found, 0.25::DOUBLE AS response_time,
      CAST(12 AS BIGINT) AS tokens_used FROM v_pairs""",
)
def i03m(spark, sf):
    rows = v_pairs(spark, sf).select("conv_id", "turn", F.col("nl").alias("nl_statement"))
    ask = expression_stage(replies.formula, prompt_tokens=5, completion_tokens=7, ms=250.0)
    out = create.translate_with_metrics(rows, ask)
    return out.select(
        "conv_id", "turn", joined(F.col("formulas")).alias("formulas"), big(F.col("candidates_found")).alias("candidates_found"), "response_time", "tokens_used"
    )


def statements_reply(q):
    """Two numbered statements on the domain that the request names."""
    domain = replies.between(q, "\n\nDomain: ", "\nTypical")
    return F.concat(F.lit("1. Agents can see each "), domain, F.lit(".\n2. After a "), domain, F.lit(" all is well."))


@query(
    "i03_generate_statements",
    """WITH s AS (SELECT event_id, event_type, unnest([0, 1]) AS item_no FROM events)
    SELECT event_id, CAST(item_no AS BIGINT) AS item_no, CASE item_no WHEN 0 THEN 'Agents can see each ' || event_type || '.' ELSE 'After a ' || event_type || ' all is well.' END AS nl_statement FROM s""",
)
def i03g(spark, sf):
    e = F.col("event_type")
    requests = events(spark, sf).select("event_id", e.alias("domain"), F.array(e).alias("agents"), F.array(e).alias("atoms"), F.lit("safety").alias("pattern"))
    out = create.generate_statements(requests, expression_stage(statements_reply))
    return out.select("event_id", big(F.col("item_no")).alias("item_no"), "nl_statement")


@query(
    "i03_experiment_rows",
    f"""WITH {FORMULAS_SQL}, a AS (SELECT *, {strip_sql('formula')} AS sf FROM v_formulas)
    SELECT event_id, {sql_joined(BOUNDARY_OPS, ' ')} AS operators, {sql_joined('list_sort(list_distinct(' + _idents('lower(formula)', vocab.NOT_IDENTIFIERS_LOWERED) + '))')} AS atoms,
      {pattern_sql('formula')} AS pattern, {sql_joined(errors_sql('sf', 'boundary', False))} AS errors, len({errors_sql('sf', 'boundary', False)}) = 0 AS syntax_valid FROM a""",
)
def i03e(spark, sf):
    rows = v_formulas(spark, sf).select("event_id", F.col("formula").alias("atl_formula"))
    return create.translated_rows(rows).select(
        "event_id", joined(F.col("operators"), " ").alias("operators"), joined(F.col("atoms")).alias("atoms"), "pattern",
        joined(F.col("syntax_errors")).alias("errors"), "syntax_valid",
    )


def verifier_reply(q):
    """A verifier whose judgement depends on the statement; its own formula is another one."""
    return (
        F.when(F.endswith(q, F.lit("nothing else.")), "<<checker>> F seen")
        .when(F.contains(q, F.lit("react to error")), '{"matches": false, "confidence": 0.3, "explanation": "no", "issues": ["wrong"], "suggested_fix": "<<a>> G (x)"}')
        .when(F.contains(q, F.lit("react to click")), "no object at all")
        .when(F.contains(q, F.lit("react to signup")), '```json{"matches": true, "confidence": 0.6}```')
        .otherwise('{"matches": true, "confidence": 0.9, "issues": []}')
    )


@query(
    "i04_verify_table",
    f"""WITH {STRUCTURE} SELECT e.event_id, CASE WHEN len(errors) > 0 THEN 'rejected' WHEN event_type IN ('error', 'click') THEN 'rejected' WHEN event_type = 'signup' THEN 'needs_review' ELSE 'verified' END AS status,
      CASE WHEN len(errors) = 0 AND event_type = 'error' THEN '<<a>> G (x)' END AS corrected_atl,
      CASE WHEN len(errors) = 0 THEN event_type = 'click' END AS parse_failed FROM e JOIN events v ON e.event_id = v.event_id""",
)
def i04(spark, sf):
    rows = v_formulas(spark, sf).select("event_id", F.col("nl").alias("nl_statement"), F.col("formula").alias("atl_formula"))
    out = verify.verify_table(rows, expression_stage(verifier_reply), cross_check=False)
    return out.select("event_id", "status", "corrected_atl", F.col("semantic_check.parse_failed").alias("parse_failed"))


@query(
    "i04_run_metrics",
    f"""WITH {STRUCTURE}, s AS (SELECT event_type, len(errors) = 0 AS valid FROM e JOIN events v ON e.event_id = v.event_id)
    SELECT count(*) AS total_samples, count(*) FILTER (WHERE valid) AS syntax_valid, count(*) FILTER (WHERE NOT valid) AS syntax_invalid, CAST(0 AS BIGINT) AS semantic_verified,
      count(*) FILTER (WHERE NOT valid OR event_type IN ('error', 'click')) AS semantic_rejected, count(*) FILTER (WHERE valid AND event_type NOT IN ('error', 'click')) AS needs_review,
      CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS cross_model_agreement, count(*) FILTER (WHERE valid) AS cross_model_disagreement FROM s""",
)
def i04m(spark, sf):
    rows = v_formulas(spark, sf).select("event_id", F.col("nl").alias("nl_statement"), F.col("formula").alias("atl_formula"))
    out = verify.verify_table(rows, expression_stage(verifier_reply))
    data = out.select("status", F.col("syntax_check.valid").alias("syntax_valid"), "cross_model_agreement", F.lit(10.0).alias("latency_ms"))
    return stats.run_metrics(data).drop("total_time_ms", "avg_time_per_sample_ms")


def translator_reply(q):
    return F.when(F.contains(q, F.lit("react to click")), "broken formula").otherwise(F.lit("⟨⟨a⟩⟩ G (p → F q)"))


def reply_by_model(q, model):
    """One model is right at times, one always, one never."""
    return F.when(model == "base", translator_reply(q)).when(model == "tuned", "⟨⟨a⟩⟩ F q").otherwise("broken formula")


def judge_reply(q):
    accept = '{"verdict": "ACCEPT", "confidence": 0.9, "issues": [], "explanation": "fine"}'
    reject = '{"verdict": "REJECT", "confidence": 0.8, "issues": ["still wrong"], "explanation": "no"}'
    return F.when(F.contains(q, F.lit("react to view")), accept).when(F.contains(q, F.lit("react to signup")), "nothing").otherwise(reject)


def judge_by_verifier(q, verifier):
    """One of the verifiers accepts nothing."""
    return F.when(verifier == "ver_0", '{"verdict": "REJECT", "confidence": 1.0, "issues": ["never"], "explanation": "no"}').otherwise(judge_reply(q))


REJECTED = "SELECT v.*, e.event_type FROM v_results v JOIN events e ON v.event_id = e.event_id WHERE verification_status = 'rejected'"


@query(
    "i05_retranslate",
    f"""WITH {RESULTS_SQL}, r AS ({REJECTED})
    SELECT id AS sample_id, CASE event_type WHEN 'click' THEN 'syntax_error' WHEN 'view' THEN 'improved' ELSE 'same' END AS status,
      event_type = 'view' AS improved, event_type <> 'click' AS finetuned_syntax_valid,
      CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'ACCEPT' WHEN 'signup' THEN 'UNKNOWN' ELSE 'REJECT' END AS finetuned_verdict FROM r""",
)
def i05(spark, sf):
    rejected = v_results(spark, sf).filter(F.col("verification_status") == "rejected")
    rejected = rejected.withColumn("agents", F.array("config_name"))
    out = compare.retranslate(rejected, expression_stage(translator_reply), expression_stage(judge_reply))
    return out.select("sample_id", "status", "improved", "finetuned_syntax_valid", "finetuned_verdict")


@query(
    "i06_compare_models",
    f"""WITH {FORMULAS_SQL} SELECT model, count(*) AS n, count(*) FILTER (WHERE model = 'tuned' OR model = 'base' AND event_type <> 'click') AS valid FROM v_formulas,
      (VALUES ('base'), ('tuned'), ('third')) AS m(model) GROUP BY 1""",
)
def i06(spark, sf):
    rows = v_formulas(spark, sf).select("event_id", F.col("nl").alias("nl_statement"))
    long = compare.compare_models(rows, ["base", "tuned", "third"], expression_stage(reply_by_model, ("model",), ms=10.0, prompt_tokens=3))
    # answers are written once, then counted
    long = cut_lineage(long, "i06")
    return stats.model_stats(long).select("model", F.col("rows").alias("n"), F.col("syntax_valid_count").alias("valid"))


@query(
    "i07_retry",
    f"""WITH {RESULTS_SQL}, t AS (SELECT *, lower(array_to_string(list_concat(coalesce(rejection_reasons, CAST([] AS VARCHAR[])), verification_notes), ' ')) AS t FROM v_results),
    r AS (SELECT t.*, e.event_type, verification_status = 'rejected' AND {RETRYABLE} AS again FROM t JOIN events e ON t.event_id = e.event_id)
    SELECT id, CASE WHEN again AND event_type = 'view' AND coalesce(verifier, 'anthropic') <> 'ver_0' THEN 'verified' WHEN again THEN 'rejected' ELSE verification_status END AS verification_status, again AS retried,
      CASE WHEN again THEN coalesce(verifier, 'anthropic') ELSE verifier END AS verifier,
      CASE WHEN NOT again THEN coalesce(array_to_string(rejection_reasons, '|'), '') WHEN coalesce(verifier, 'anthropic') = 'ver_0' THEN 'never' WHEN event_type = 'view' THEN ''
        WHEN event_type = 'signup' THEN 'Could not parse response' ELSE 'still wrong' END AS reasons
    FROM r WHERE verification_status IN ('verified', 'rejected')""",
)
def i07(spark, sf):
    rows = v_results(spark, sf)
    s = F.col("verification_status")
    merged, _ = compare.retry_rejections(rows.filter(s == "verified"), rows.filter(s == "rejected"), expression_stage(judge_by_verifier, ("model",)))
    return merged.select(
        "id", "verification_status", F.coalesce("retry_attempt", F.lit(False)).alias("retried"), "verifier", joined(F.col("rejection_reasons")).alias("reasons")
    )


# streaming ---------------------------------------------------------------------------------------------------------

SAMPLES_SQL = f"""{FORMULAS_SQL}, a AS (SELECT *, {ascii_sql('formula')} AS f FROM v_formulas)"""


def stream_formulas(rows):
    """Event rows to samples; row-wise, so it runs on a stream as on a table."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    user = F.col("user_id").cast("string")
    nl = F.concat(F.lit("The user "), user, F.lit(" must react to "), F.col("event_type"), F.lit(" by a message with code "), k.cast("string"))
    f = F.concat(F.lit("⟨⟨user_"), user, F.lit("⟩⟩ G ("), F.col("event_type"), F.lit(" → F done_"), k.cast("string"), F.lit(")"))
    pairs = rows.select("event_id", "ts", nl.alias("nl"), f.alias("formula"))
    return pairs.select("event_id", "ts", *sample_columns(F.col("nl"), F.col("formula")))


STREAMED = """st0 AS (SELECT event_id, 'The user ' || user_id || ' must react to ' || event_type || ' by a message with code ' || regexp_extract(props, '([0-9]+)', 1) AS nl,
  '<<user_' || user_id || '>> G (' || event_type || ' -> F done_' || regexp_extract(props, '([0-9]+)', 1) || ')' AS f FROM events),
st AS (SELECT event_id, substring(sha256(lower(nl) || '|' || f), 1, 12) AS id, nl, f FROM st0)"""


def streamed(spark, sf, label):
    path = run_dir(spark, label)
    rows = jobs.stream_table(spark, f"{sf}/events.parquet")
    tasks = spark.sparkContext.defaultParallelism
    jobs.append_enriched(rows, stream_formulas, f"{path}/out", f"{path}/checkpoint", tasks).awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("k08_incremental_save", f"WITH {STREAMED} SELECT event_id, id FROM st")
def k08(spark, sf):
    return streamed(spark, sf, "k08").select("event_id", "id")


@query(
    "x01_stream_enrich",
    f"WITH {STREAMED} SELECT event_id, id, f AS atl_formula, {classify_sql("lower(nl || ' ' || f)")} AS domain FROM st",
)
def x01(spark, sf):
    return streamed(spark, sf, "x01").select("event_id", "id", "atl_formula", "domain")


@query("x02_stream_dedup", f"WITH {STREAMED} SELECT DISTINCT id FROM st")
def x02(spark, sf):
    path = run_dir(spark, "x02")
    rows = stream_formulas(jobs.stream_table(spark, f"{sf}/events.parquet")).select("id", F.col("ts").cast("timestamp").alias("ts"))
    jobs.insert_absent_stream(rows, "id", "ts", "60 days", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id")


# Three deliveries into a store that has the signups: up to the middle of the month, the rest, and everything once more.
DELIVERIES = f"""{STREAMED}, w AS (SELECT id, ts, event_type = 'signup' AS pre, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS b FROM st JOIN events USING (event_id)),
first AS (SELECT id, bool_or(pre) AS pre, min(b) AS b FROM w GROUP BY id)"""


def delivered(spark, sf, label):
    path = run_dir(spark, label)
    e = events(spark, sf)
    order = F.col("event_id")
    store.create_store(stream_formulas(e.where("event_type = 'signup'")).select("id", "nl_statement", "event_id"), "id", order, f"{path}/store", digits=1)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    for part in (early, ~early, F.lit(True)):
        e.where(part).drop("k").write.mode("append").parquet(f"{path}/in")
        rows = stream_formulas(jobs.stream_table(spark, f"{path}/in")).select("id", "nl_statement", "event_id")
        store.insert_into_store(rows, "id", order, f"{path}/store", f"{path}/checkpoint").awaitTermination()
    return f"{path}/store"


@query(
    "x02_insert_into_store",
    f"""WITH {DELIVERIES}, n AS (SELECT b, count(*) AS n FROM w GROUP BY b UNION ALL SELECT 2, count(*) FROM w),
    a AS (SELECT b, count(*) AS added FROM first WHERE NOT pre GROUP BY b)
    SELECT CAST(b AS BIGINT) AS batch_no, coalesce(added, 0)::BIGINT AS added, (n - coalesce(added, 0))::BIGINT AS duplicates FROM n LEFT JOIN a USING (b)""",
)
def x02s(spark, sf):
    return store.batch_counts(spark, delivered(spark, sf, "x02s")).drop("stream")


@query(
    "x02_stored_rows",
    f"""WITH {DELIVERIES}, o AS (SELECT id, min(event_id) FILTER (event_type = 'signup') AS pre_id, min(event_id) FILTER (ts < TIMESTAMP '2024-01-16') AS early_id, min(event_id) AS any_id
      FROM st JOIN events USING (event_id) GROUP BY id)
    SELECT id, coalesce(pre_id, early_id, any_id) AS event_id, CASE WHEN pre THEN 'start' WHEN b = 0 THEN '0' ELSE '1' END AS came_with FROM o JOIN first USING (id)""",
)
def x02r(spark, sf):
    rows = store.read_store(spark, delivered(spark, sf, "x02r"))
    return rows.select("id", "event_id", F.substring_index("batch", "-", -1).alias("came_with"))


def log_stream(spark, sf):
    e = jobs.stream_table(spark, f"{sf}/events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return e.select(
        F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("domain"), (F.col("event_type") != "error").alias("syntax_valid"),
        F.when(k >= 70, True).when(k < 30, False).alias("semantic_verified"), (k / F.lit(100.0)).cast("decimal(9,2)").alias("confidence"),
        F.when(F.pmod(k, F.lit(11)) != 0, F.pmod("event_id", F.lit(7)) != 0).alias("cross_model_agreement"),
        F.when(k < 40, "rejected").when(k < 55, "needs_review").otherwise("verified").alias("verification_status"),
    )


@query(
    "x03_stream_quality",
    f"""WITH {LOG_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, domain, count(*) AS total_samples, count(*) FILTER (WHERE semantic_verified) AS semantic_verified_count,
      CAST(sum(confidence) FILTER (WHERE confidence > 0) AS DOUBLE) / count(*) FILTER (WHERE confidence > 0) AS avg_confidence FROM v_log GROUP BY 1, 2""",
)
def x03(spark, sf):
    path = run_dir(spark, "x03")
    jobs.snapshot_quality(log_stream(spark, sf), "ts", f"{path}/out", f"{path}/checkpoint").awaitTermination()
    rows = jobs.latest_snapshot(spark, f"{path}/out")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "domain", "total_samples", "semantic_verified_count", "avg_confidence")


@query(
    "x04_stream_routing",
    f"""WITH {RESULTS_SQL} SELECT verification_status, count(*) AS n, min(event_id) AS first_event FROM v_results GROUP BY 1""",
)
def x04(spark, sf):
    path = run_dir(spark, "x04")
    jobs.route_by_status(log_stream(spark, sf), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("verification_status").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query(
    "x04_stream_stats",
    f"""WITH {LOG_SQL}, r AS (SELECT CASE WHEN CAST(confidence AS DOUBLE) < 0.4 THEN 'rejected' WHEN CAST(confidence AS DOUBLE) < 0.55 THEN 'needs_review' ELSE 'verified' END AS route, confidence FROM v_log)
    SELECT route, count(*) AS n, CAST(sum(confidence) AS DOUBLE) AS confidence_sum, count(confidence) AS confidence_count FROM r GROUP BY 1""",
)
def x04s(spark, sf):
    path = run_dir(spark, "x04s")
    jobs.route_by_status(log_stream(spark, sf), f"{path}/out", f"{path}/checkpoint", stats=f"{path}/stats", measures={"confidence": F.col("confidence")}).awaitTermination()
    rows = jobs.routed_stats(spark, f"{path}/stats")
    return rows.select("route", "n", "confidence_sum", "confidence_count")
