"""Aggregations over stores, logs and comparisons; trends, histories and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog.formulas import PROFILE_SQL, AGENTS, ASCII, ATOMS, LOOSE_OPS, SCORE, pattern_sql
from pairwright.catalog.registry import big, query
from pairwright.catalog.rows import CASCADE, FIELDS, J05, marked, retried_sets
from pairwright.catalog.views import CORPUS_SQL, FORMULAS_SQL, LOG_SQL, RESULTS_SQL, table, v_corpus, v_formulas, v_log, v_results
from pairwright.functions import formula as fx
from pairwright.functions.profile import formula_profile
from pairwright.operators import choose, sketches, stats
from pairwright.operators.enrich import sample_columns
from pairwright.operators.ranking import measured, with_columns_of


def store(spark, sf):
    """The formula view as a sample store."""
    k = F.col("k")
    rows = v_formulas(spark, sf).select(
        "event_id", "k", "event_type", *sample_columns(F.col("nl"), F.col("formula"), F.col("template_id"))
    )
    return rows.select(
        "event_id", "id", "atl_formula", "template_id", "agents", "operators", "atoms",
        F.col("event_type").alias("domain"),
        F.when(F.pmod(k, F.lit(9)) != 0, F.concat(F.lit("file_"), F.pmod(k, F.lit(4)).cast("string"))).alias("source_file"),
        F.when(k >= 30, k >= 50).alias("semantic_verified"),
        (F.pmod(k, F.lit(5)) != 0).alias("syntax_valid"),
    )


STORE = f"""{ASCII}, store AS (SELECT event_id, event_type AS domain, f, {AGENTS} AS agents, {LOOSE_OPS} AS operators, {ATOMS} AS atoms,
  {SCORE} AS score, CASE WHEN k % 9 <> 0 THEN 'file_' || (k % 4) END AS source_file,
  CASE WHEN k >= 30 THEN k >= 50 END AS semantic_verified, k % 5 <> 0 AS syntax_valid FROM a)"""


def _u(col: str) -> str:
    return f"SELECT DISTINCT unnest({col}) AS x FROM store"


@query(
    "a01_store_stats",
    f"""WITH {STORE} SELECT count(*) AS total_samples, count(*) FILTER (WHERE semantic_verified) AS verified_count,
      count(*) FILTER (WHERE syntax_valid) AS syntax_valid_count, round_even(CAST(sum(score) AS DOUBLE) / count(*), 2) AS avg_complexity,
      count(DISTINCT domain) AS unique_domains, (SELECT count(*) FROM ({_u('agents')})) AS unique_agents,
      (SELECT count(*) FROM ({_u('atoms')})) AS unique_atoms FROM store""",
)
def a01(spark, sf):
    return stats.store_stats(store(spark, sf))


@query(
    "a01_store_histograms",
    f"""WITH {STORE} SELECT dimension, value, count(*) AS n FROM (
      SELECT 'domain' AS dimension, domain AS value FROM store UNION ALL SELECT 'source_file', coalesce(source_file, 'unknown') FROM store
      UNION ALL SELECT 'operator', unnest(operators) FROM store UNION ALL SELECT 'agent', unnest(agents) FROM store
      UNION ALL SELECT 'atom', unnest(atoms) FROM store) GROUP BY 1, 2""",
)
def a01h(spark, sf):
    return stats.store_histograms(store(spark, sf))


@query(
    "a01_sketched_counts",
    "SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY 1",
)
def a01s(spark, sf):
    """Daily sketches merged by kind of event, held against the exact figures: within four standard errors, two percent in rank."""
    rows = table(spark, sf, "events").select("event_type", "user_id", "value", F.to_date("ts").alias("day"))
    days = sketches.sketches(rows, ["day", "event_type"], {"users": "user_id"}, {"value": F.col("value")})
    figures = measured(sketches.estimates(sketches.merged(days, ["event_type"])).select("event_type", "distinct_users", "value_median"))
    users, near = F.count_distinct("user_id"), F.col("value_median")
    below, upto, numbers = F.count_if(F.col("value") < near), F.count_if(F.col("value") <= near), F.count("value")
    return with_columns_of(rows, figures, ["event_type"]).groupBy("event_type", "distinct_users").agg(
        F.count(F.lit(1)).alias("rows"), users.alias("users"),
        (F.abs(F.col("distinct_users") - users) <= 4 * sketches.hll_error() * users + 1).alias("users_near"),
        ((below <= 0.52 * numbers) & (upto >= 0.48 * numbers)).alias("median_near"),
    ).drop("distinct_users")


def profiled(spark, sf):
    return v_formulas(spark, sf).select(
        "nl", F.col("formula").alias("atl"), "template_id",
        F.concat(F.lit("src_"), F.pmod("user_id", F.lit(6)).cast("string")).alias("source"),
        formula_profile(F.col("formula")).alias("profile"),
    )


PROFILED_SQL = f"""{PROFILE_SQL}, prof AS (SELECT pr.*, f.formula, len(regexp_extract_all(pr.nl, '\\S+')) AS w, length(f.formula) AS c,
  CASE WHEN valid THEN list_transform(regexp_extract_all(CASE WHEN led THEN shape ELSE replace(shape, '⟨⟨{{coalition}}⟩⟩', '') END, '⟨⟨|[GFXU¬→∧∨]'),
    lambda x: CASE WHEN x = '⟨⟨' THEN '⟨⟨⟩⟩' ELSE x END) END AS symbols FROM pr JOIN v_formulas f USING (event_id))"""

HIST_SQL = f"""{PROFILED_SQL}, vals AS (
  SELECT 'source' AS dimension, 'src_' || (user_id % 6) AS value FROM prof UNION ALL SELECT 'template', template_id FROM prof
  UNION ALL SELECT 'depth', CAST(depth AS VARCHAR) FROM prof WHERE valid UNION ALL SELECT 'symbol', unnest(symbols) FROM prof WHERE valid
  UNION ALL SELECT 'coalition', array_to_string(agents, ',') FROM prof WHERE valid AND led
  UNION ALL SELECT 'coalition_size', CAST(len(agents) AS VARCHAR) FROM prof WHERE valid AND led
  UNION ALL SELECT 'atom', unnest(atoms) FROM prof WHERE valid),
hist AS (SELECT dimension, value, count(*) AS n FROM vals GROUP BY 1, 2)"""


@query(
    "a02_dataset_stats",
    f"""WITH {PROFILED_SQL} SELECT count(*) AS total_pairs, count(*) FILTER (WHERE valid) AS valid_atl_count, count(*) FILTER (WHERE NOT valid) AS invalid_atl_count,
      count(*) FILTER (WHERE valid) / count(*)::DOUBLE AS validity_rate, sum(w)::DOUBLE / count(*) AS avg_nl_length, sum(c)::DOUBLE / count(*) AS avg_atl_length,
      round(stddev_samp(w), 6) AS nl_length_std, round(stddev_samp(c), 6) AS atl_length_std, min(w)::BIGINT AS min_nl_length, max(w)::BIGINT AS max_nl_length,
      min(c)::BIGINT AS min_atl_length, max(c)::BIGINT AS max_atl_length FROM prof""",
)
def a02(spark, sf):
    return _rounded(stats.dataset_stats(profiled(spark, sf)))


def _rounded(out):
    for c in ["nl_length_std", "atl_length_std"]:
        out = out.withColumn(c, F.round(c, 6))
    for c in ["min_nl_length", "max_nl_length", "min_atl_length", "max_atl_length"]:
        out = out.withColumn(c, big(F.col(c)))
    return out


@query("a02_dataset_histograms", f"WITH {HIST_SQL} SELECT dimension, value, n FROM hist")
def a02h(spark, sf):
    return stats.dataset_histograms(profiled(spark, sf))


@query(
    "a02_lengths",
    f"""WITH {CORPUS_SQL}, l AS (SELECT len(regexp_extract_all(nl_statement, '\\S+')) AS w, length(atl_formula) AS c,
      coalesce(syntax_valid, false) AS v FROM v_corpus)
    SELECT count(*) AS total_pairs, count(*) FILTER (WHERE v) AS valid_atl_count, count(*) - count(*) FILTER (WHERE v) AS invalid_atl_count,
      count(*) FILTER (WHERE v) / count(*)::DOUBLE AS validity_rate, sum(w)::DOUBLE / count(*) AS avg_nl_length, sum(c)::DOUBLE / count(*) AS avg_atl_length,
      round(stddev_samp(w), 6) AS nl_length_std, round(stddev_samp(c), 6) AS atl_length_std, min(w)::BIGINT AS min_nl_length, max(w)::BIGINT AS max_nl_length,
      min(c)::BIGINT AS min_atl_length, max(c)::BIGINT AS max_atl_length FROM l""",
)
def a02l(spark, sf):
    rows = v_corpus(spark, sf).select(
        F.col("nl_statement").alias("nl"), F.col("atl_formula").alias("atl"), F.struct(F.col("syntax_valid").alias("valid")).alias("profile")
    )
    return _rounded(stats.dataset_stats(rows))


EXPECTED = "', '".join(vocab.EXPECTED_SYMBOLS)


@query(
    "a03_dataset_scores",
    f"""WITH {HIST_SQL}, s AS (SELECT least(1.0, count(*) FILTER (WHERE dimension IN ('template', 'source', 'depth', 'symbol')) / 40.0::DOUBLE) AS diversity_score,
      count(*) FILTER (WHERE dimension = 'symbol' AND value IN ('{EXPECTED}')) / {len(vocab.EXPECTED_SYMBOLS)}::DOUBLE AS coverage_score,
      sum(n) FILTER (WHERE dimension = 'symbol') AS symbols, sum(n) FILTER (WHERE dimension = 'depth') AS valid, sum(n) FILTER (WHERE dimension = 'source') AS total,
      sum(n * CAST(CASE WHEN dimension = 'depth' THEN value END AS INTEGER)) AS depths,
      count(*) FILTER (WHERE dimension = 'atom') AS unique_atoms, count(*) FILTER (WHERE dimension = 'coalition') AS unique_coalitions FROM hist)
    SELECT diversity_score::DOUBLE AS diversity_score, valid / total::DOUBLE AS validity_rate, coverage_score,
      (depths::DOUBLE / valid + symbols::DOUBLE / valid) / 2 AS avg_formula_complexity, unique_atoms, unique_coalitions FROM s""",
)
def a03(spark, sf):
    return stats.dataset_scores(stats.dataset_histograms(profiled(spark, sf)))


QUALITY = """count(*) AS total_samples, count(*) FILTER (WHERE syntax_valid) AS syntax_valid_count,
  count(*) FILTER (WHERE syntax_valid) / count(*)::DOUBLE AS syntax_valid_rate, count(*) FILTER (WHERE semantic_verified) AS semantic_verified_count,
  count(*) FILTER (WHERE semantic_verified) / count(*)::DOUBLE AS semantic_verified_rate,
  count(*) FILTER (WHERE NOT semantic_verified) AS semantic_rejected_count, count(*) FILTER (WHERE semantic_verified IS NULL) AS needs_review_count,
  count(*) FILTER (WHERE cross_model_agreement) AS cross_model_agreement_count,
  count(*) FILTER (WHERE cross_model_agreement) / count(*)::DOUBLE AS cross_model_agreement_rate,
  coalesce(CAST(sum(confidence) FILTER (WHERE confidence > 0) AS DOUBLE) / count(*) FILTER (WHERE confidence > 0), 0.0) AS avg_confidence,
  coalesce(CAST(min(confidence) FILTER (WHERE confidence > 0) AS DOUBLE), 0.0) AS min_confidence,
  coalesce(CAST(max(confidence) FILTER (WHERE confidence > 0) AS DOUBLE), 0.0) AS max_confidence,
  round(coalesce(stddev_samp(CAST(confidence AS DOUBLE)) FILTER (WHERE confidence > 0), 0.0), 6) AS confidence_std"""


@query("a04_quality", f"WITH {LOG_SQL} SELECT {QUALITY} FROM v_log")
def a04(spark, sf):
    return stats.verification_quality(v_log(spark, sf)).withColumn("confidence_std", F.round("confidence_std", 6))


@query("a04_quality_by_domain", f"WITH {LOG_SQL} SELECT domain, model, {QUALITY} FROM v_log GROUP BY 1, 2")
def a04d(spark, sf):
    return stats.verification_quality(v_log(spark, sf), ["domain", "model"]).withColumn("confidence_std", F.round("confidence_std", 6))


@query(
    "a05_diversity",
    f"""WITH {LOG_SQL}, d AS (SELECT domain, count(*) AS n FROM v_log GROUP BY 1), t AS (SELECT sum(n) AS t FROM d)
    SELECT (SELECT count(*) FROM d) AS unique_domains, (SELECT round_even(-sum(n / t::DOUBLE * log2(n / t::DOUBLE)), 3) FROM d, t) AS domain_entropy,
      round_even(CAST(sum(complexity) AS DOUBLE) / count(*), 2) AS avg_complexity, count(*) FILTER (WHERE complexity <= 3) AS low,
      count(*) FILTER (WHERE complexity > 3 AND complexity <= 6) AS medium, count(*) FILTER (WHERE complexity > 6) AS high FROM v_log""",
)
def a05(spark, sf):
    return stats.diversity(v_log(spark, sf))


@query(
    "a06_performance",
    f"""WITH {LOG_SQL} SELECT model, CAST(sum(latency_ms) AS DOUBLE) AS total_time_ms, CAST(sum(latency_ms) AS DOUBLE) / count(*) AS avg_time_per_sample_ms,
      CAST(min(latency_ms) AS DOUBLE) AS min_time_ms, CAST(max(latency_ms) AS DOUBLE) AS max_time_ms, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens,
      CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) / count(*)::DOUBLE AS avg_tokens_per_sample,
      round_even(CAST(sum(prompt_tokens) AS BIGINT) / 1000.0::DOUBLE * 0.03::DOUBLE + CAST(sum(completion_tokens) AS BIGINT) / 1000.0::DOUBLE * 0.06::DOUBLE, 4) AS estimated_cost_usd,
      round_even(count(*) / (CAST(sum(latency_ms) AS DOUBLE) / 60000.0::DOUBLE), 2) AS samples_per_minute FROM v_log GROUP BY 1""",
)
def a06(spark, sf):
    return stats.performance(v_log(spark, sf), ["model"])


RUN_STATUS = """CASE WHEN NOT syntax_valid THEN 'rejected' WHEN error IS NOT NULL THEN 'error' WHEN semantic_verified THEN 'verified'
  WHEN NOT semantic_verified THEN 'rejected' ELSE 'needs_review' END"""


@query(
    "a07_run_metrics",
    f"""WITH {LOG_SQL}, r AS (SELECT *, {RUN_STATUS} AS status FROM v_log)
    SELECT model, count(*) AS total_samples, count(*) FILTER (WHERE syntax_valid) AS syntax_valid, count(*) FILTER (WHERE NOT syntax_valid) AS syntax_invalid,
      count(*) FILTER (WHERE status = 'verified') AS semantic_verified, count(*) FILTER (WHERE status = 'rejected') AS semantic_rejected,
      count(*) FILTER (WHERE status = 'needs_review') AS needs_review, count(*) FILTER (WHERE status = 'error') AS errors,
      count(*) FILTER (WHERE cross_model_agreement) AS cross_model_agreement, count(*) FILTER (WHERE NOT cross_model_agreement) AS cross_model_disagreement,
      CAST(sum(latency_ms) AS DOUBLE) AS total_time_ms, CAST(sum(latency_ms) AS DOUBLE) / count(*) AS avg_time_per_sample_ms FROM r GROUP BY 1""",
)
def a07(spark, sf):
    status = (
        F.when(~F.col("syntax_valid"), "rejected").when(F.col("error").isNotNull(), "error")
        .when(F.col("semantic_verified"), "verified").when(~F.col("semantic_verified"), "rejected").otherwise("needs_review")
    )
    return stats.run_metrics(v_log(spark, sf).withColumn("status", status), ["model"])


@query(
    "a08_rollups",
    f"""WITH {RESULTS_SQL}, r AS (SELECT coalesce(domain, 'unknown') AS domain, config_name, verification_status AS s FROM v_results)
    SELECT CASE WHEN GROUPING(domain) = 0 THEN 'domain' WHEN GROUPING(config_name) = 0 THEN 'config_name' ELSE 'all' END AS dimension,
      coalesce(domain, config_name, 'all') AS value, count(*) AS total, count(*) FILTER (WHERE s = 'verified') AS verified,
      count(*) FILTER (WHERE s = 'rejected') AS rejected, count(*) FILTER (WHERE s NOT IN ('verified', 'rejected')) AS needs_review
    FROM r GROUP BY GROUPING SETS ((domain), (config_name), ())""",
)
def a08(spark, sf):
    return stats.rollups(v_results(spark, sf), ["config_name", "domain"])


@query(
    "a08_issue_counts",
    f"""WITH {RESULTS_SQL} SELECT substring(r, 1, 80) AS reason, count(*) AS n FROM (SELECT unnest(rejection_reasons[1:2]) AS r FROM v_results) GROUP BY 1""",
)
def a08i(spark, sf):
    return stats.issue_counts(v_results(spark, sf), "rejection_reasons", 2, 80)


def experiment_rows(spark, sf):
    f = fx.to_ascii(F.col("atl_formula"))
    return v_results(spark, sf).withColumn("operators", fx.temporal_operators(F.col("atl_formula"))).withColumn("pattern", fx.pattern(f))


@query(
    "a09_experiment_histograms",
    f"""WITH {RESULTS_SQL}, a AS (SELECT event_id, f FROM ({ASCII.split('a AS (', 1)[1].rsplit(')', 1)[0]})),
    r AS (SELECT v.*, a.f, {LOOSE_OPS} AS operators FROM v_results v JOIN a USING (event_id))
    SELECT dimension, value, count(*) AS n FROM (
      SELECT 'domain' AS dimension, coalesce(domain, 'unknown') AS value FROM r UNION ALL SELECT 'generator', atl_generator FROM r
      UNION ALL SELECT 'verifier', coalesce(verifier, 'unknown') FROM r UNION ALL SELECT 'pattern', {pattern_sql('f')} FROM r
      UNION ALL SELECT 'operator', unnest(operators) FROM r) GROUP BY 1, 2""",
)
def a09(spark, sf):
    return stats.experiment_histograms(experiment_rows(spark, sf))


@query(
    "a09_unified_stats",
    f"""WITH {STORE}, c AS (SELECT *, len(operators) + len(agents) AS c FROM store)
    SELECT count(*) AS total_samples, count(*) FILTER (WHERE semantic_verified) AS verified_count, count(*) FILTER (WHERE syntax_valid) AS syntax_valid_count,
      round_even(CAST(sum(c) AS DOUBLE) / count(*), 2) AS avg_complexity, count(DISTINCT domain) AS unique_domains,
      (SELECT count(*) FROM ({_u('agents')})) AS unique_agents, (SELECT count(*) FROM ({_u('atoms')})) AS unique_atoms FROM c""",
)
def a09u(spark, sf):
    rows = store(spark, sf).select(
        "domain", "agents", "atoms", "operators",
        F.when(F.col("semantic_verified"), "verified").otherwise("rejected").alias("verification_status"),
        F.when(~F.col("syntax_valid"), F.array(F.lit("bad"))).alias("syntax_errors"),
    )
    return stats.unified_stats(rows)


@query(
    "a10_top_reasons",
    f"""WITH {RESULTS_SQL} SELECT substring(r, 1, 100) AS reason, count(*) AS n FROM (SELECT unnest(rejection_reasons) AS r FROM v_results)
    GROUP BY 1 ORDER BY n DESC, reason LIMIT 20""",
)
def a10(spark, sf):
    return stats.top(stats.issue_counts(v_results(spark, sf), "rejection_reasons", None, 100), "reason", 20)


@query(
    "a11_retranslation_stats",
    f"""WITH {RESULTS_SQL}, r AS (SELECT CASE WHEN k % 6 = 0 THEN 'syntax_error' WHEN k % 6 = 1 THEN 'error' WHEN k % 6 = 2 THEN 'pending'
        WHEN k % 6 = 3 THEN 'improved' ELSE 'same' END AS status, k % 6 >= 2 AS ok, CASE WHEN k % 6 = 3 THEN 'ACCEPT' WHEN k % 6 > 3 THEN 'REJECT' END AS verdict,
        verification_confidence AS c FROM v_results WHERE verification_status = 'rejected')
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'improved') AS improved, count(*) FILTER (WHERE status = 'improved') / count(*)::DOUBLE * 100 AS improvement_rate,
      count(*) FILTER (WHERE status = 'same') AS same, count(*) FILTER (WHERE status = 'syntax_error') AS syntax_errors, count(*) FILTER (WHERE status = 'error') AS errors,
      count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE ok) AS syntax_valid, count(*) FILTER (WHERE ok) / count(*)::DOUBLE * 100 AS syntax_valid_rate,
      count(*) FILTER (WHERE verdict = 'ACCEPT') AS accepted, count(*) FILTER (WHERE verdict = 'REJECT') AS rejected,
      count(*) FILTER (WHERE verdict = 'ACCEPT') / (count(verdict))::DOUBLE * 100 AS acceptance_rate,
      CAST(sum(c) FILTER (WHERE verdict = 'ACCEPT' AND c <> 0) AS DOUBLE) / (count(*) FILTER (WHERE verdict = 'ACCEPT' AND c <> 0)) AS avg_confidence FROM r""",
)
def a11(spark, sf):
    k = F.pmod("k", F.lit(6))
    status = F.when(k == 0, "syntax_error").when(k == 1, "error").when(k == 2, "pending").when(k == 3, "improved").otherwise("same")
    rows = v_results(spark, sf).filter(F.col("verification_status") == "rejected").select(
        status.alias("status"), (k >= 2).alias("finetuned_syntax_valid"),
        F.when(k == 3, "ACCEPT").when(k > 3, "REJECT").alias("finetuned_verdict"),
        F.col("verification_confidence").alias("finetuned_confidence"),
    )
    return stats.retranslation_stats(rows)


def comparison(spark, sf):
    return v_log(spark, sf).select(
        "model", F.col("latency_ms").alias("response_time"), (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens_used"),
        "syntax_valid", "error",
    )


@query(
    "a12_model_stats",
    f"""WITH {LOG_SQL}, o AS (SELECT *, prompt_tokens + completion_tokens AS tokens, row_number() OVER (PARTITION BY model ORDER BY latency_ms) - 1 AS i,
        count(*) OVER (PARTITION BY model) AS n FROM v_log WHERE error IS NULL),
      m AS (SELECT model, latency_ms AS median_time FROM o WHERE i = n // 2)
    SELECT v.model, count(*) AS rows, count(error) AS error_count, CAST(sum(latency_ms) FILTER (WHERE error IS NULL) AS DOUBLE) / (count(*) - count(error)) AS avg_time,
      CAST(min(latency_ms) FILTER (WHERE error IS NULL) AS DOUBLE) AS min_time, CAST(max(latency_ms) FILTER (WHERE error IS NULL) AS DOUBLE) AS max_time,
      CAST(sum(prompt_tokens + completion_tokens) FILTER (WHERE error IS NULL) AS DOUBLE) / (count(*) - count(error)) AS avg_tokens,
      CAST(sum(prompt_tokens + completion_tokens) FILTER (WHERE error IS NULL) AS BIGINT) AS total_tokens,
      count(*) FILTER (WHERE error IS NULL AND syntax_valid) AS syntax_valid_count,
      count(*) FILTER (WHERE error IS NULL AND syntax_valid) / (count(*) - count(error))::DOUBLE AS syntax_valid_rate,
      count(*) FILTER (WHERE error IS NULL AND syntax_valid) / count(*)::DOUBLE AS syntax_valid_rate_of_all,
      CAST(any_value(m.median_time) AS DOUBLE) AS median_time FROM v_log v JOIN m ON v.model = m.model GROUP BY v.model""",
)
def a12(spark, sf):
    return stats.model_stats(comparison(spark, sf))


def reviews(spark, sf):
    k = F.pmod("sample_id", F.lit(5))
    return v_log(spark, sf).select(
        "model", F.when(k < 2, True).when(k == 2, False).alias("correct"),
        F.when(F.col("error").isNull(), F.col("latency_ms")).otherwise(0).alias("response_time"), "syntax_valid", "error",
    )


ACCURACY = f"""{LOG_SQL}, rv AS (SELECT model, CASE WHEN sample_id % 5 < 2 THEN true WHEN sample_id % 5 = 2 THEN false END AS correct,
    CASE WHEN error IS NULL THEN latency_ms ELSE 0 END AS t, syntax_valid, error FROM v_log),
  acc AS (SELECT model, count(*) AS rows, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE NOT correct) AS incorrect,
    count(*) FILTER (WHERE correct IS NULL) AS not_reviewed, count(correct) AS total_reviewed,
    count(*) FILTER (WHERE correct) / nullif(count(correct), 0)::DOUBLE AS accuracy, count(*) FILTER (WHERE syntax_valid) AS syntax_valid_count,
    CAST(sum(t) AS DOUBLE) / count(*) AS avg_response_time, count(*) - count(error) AS answered FROM rv GROUP BY 1)"""


@query("a13_review_accuracy", f"WITH {ACCURACY} SELECT * FROM acc")
def a13(spark, sf):
    return stats.review_accuracy(reviews(spark, sf))


@query(
    "a14_best_models",
    f"""WITH {ACCURACY} SELECT (SELECT model FROM acc ORDER BY accuracy DESC, model LIMIT 1) AS most_accurate, (SELECT max(accuracy) FROM acc) AS best_accuracy,
      (SELECT model FROM acc WHERE answered > 0 ORDER BY avg_response_time, model LIMIT 1) AS fastest,
      (SELECT min(avg_response_time) FROM acc WHERE answered > 0) AS fastest_time""",
)
def a14(spark, sf):
    return stats.best_models(stats.review_accuracy(reviews(spark, sf)))


@query(
    "a14_syntax_error_rates",
    f"""WITH {ACCURACY} SELECT model, rows - syntax_valid_count AS syntax_errors, (rows - syntax_valid_count) / rows::DOUBLE AS syntax_error_rate FROM acc""",
)
def a14s(spark, sf):
    return stats.syntax_error_rates(stats.review_accuracy(reviews(spark, sf)))


@query(
    "a15_training_stats",
    f"""WITH {RESULTS_SQL}, m AS (SELECT id, {CASCADE} AS ff, {FIELDS} AS fe FROM v_results), t AS (SELECT count(*) FILTER (WHERE ff IS NULL AND fe IS NULL) AS v FROM m)
    SELECT count(*) AS total_samples, count(*) FILTER (WHERE ff = 'filtered_confidence') AS filtered_confidence, count(*) FILTER (WHERE ff = 'filtered_status') AS filtered_status,
      count(*) FILTER (WHERE ff = 'filtered_domain') AS filtered_domain, count(*) FILTER (WHERE ff IS NULL) AS passed, any_value(v) AS valid_samples,
      count(*) FILTER (WHERE ff IS NULL AND fe IS NOT NULL) AS invalid_samples, any_value(v) - greatest(1, CAST(floor(any_value(v) * 0.1::DOUBLE) AS BIGINT)) AS training_samples,
      greatest(1, CAST(floor(any_value(v) * 0.1::DOUBLE) AS BIGINT)) AS validation_samples, round(any_value(v) * 600 / 1000.0::DOUBLE * 0.003::DOUBLE, 9) AS training_cost_usd FROM m, t""",
)
def a15(spark, sf):
    return stats.training_stats(marked(spark, sf), 0.1).withColumn("training_cost_usd", F.round("training_cost_usd", 9))


@query(
    "a16_retry_stats",
    f"""WITH {J05} SELECT count(*) AS total_retried, count(*) FILTER (WHERE verification_status = 'verified') AS newly_verified,
      count(*) FILTER (WHERE verification_status <> 'verified') AS still_rejected, CAST(0 AS BIGINT) AS retry_errors FROM merged WHERE retried""",
)
def a16(spark, sf):
    _, _, again = retried_sets(spark, sf)
    return stats.retry_stats(again.withColumn("verification_verdict", F.lit("REJECT")))


@query(
    "a17_funnel",
    f"""WITH {RESULTS_SQL} SELECT 'generated' AS stage, count(*) AS n FROM v_results UNION ALL SELECT 'unique', count(DISTINCT nl_statement) FROM v_results
      UNION ALL SELECT 'verified', count(*) FROM v_results WHERE verification_status = 'verified'
      UNION ALL SELECT 'rejected', count(*) FROM v_results WHERE verification_status = 'rejected'""",
)
def a17(spark, sf):
    rows = v_results(spark, sf)
    s = F.col("verification_status")
    return stats.funnel(rows, {"generated": F.lit(True), "verified": s == "verified", "rejected": s == "rejected"}, {"unique": F.col("nl_statement")})


@query(
    "a17_verified_breakdown",
    f"""WITH {RESULTS_SQL}, a AS (SELECT event_id, f FROM ({ASCII.split('a AS (', 1)[1].rsplit(')', 1)[0]})),
    r AS (SELECT v.*, a.f FROM v_results v JOIN a USING (event_id) WHERE verification_status = 'verified')
    SELECT dimension, value, count(*) AS n FROM (SELECT 'domain' AS dimension, coalesce(domain, 'unknown') AS value FROM r
      UNION ALL SELECT 'pattern', {pattern_sql('f')} FROM r) GROUP BY 1, 2""",
)
def a17b(spark, sf):
    good = experiment_rows(spark, sf).filter(F.col("verification_status") == "verified")
    return stats.histograms(good, {"domain": F.col("domain"), "pattern": F.col("pattern")})


@query(
    "a18_success_summary",
    f"""WITH {ASCII} SELECT count(*) FILTER (WHERE contains(f, '<<') AND len({LOOSE_OPS}) > 0) AS successes, count(*) AS total,
      count(*) FILTER (WHERE contains(f, '<<') AND len({LOOSE_OPS}) > 0) / count(*)::DOUBLE AS success_rate FROM a""",
)
def a18(spark, sf):
    f = F.col("formula")
    ok = F.contains(fx.to_ascii(f), F.lit("<<")) & (F.size(fx.temporal_operators(f)) > 0)
    return stats.success_summary(v_formulas(spark, sf), ok)


# ordered results ---------------------------------------------------------------------------------------------------


@query(
    "w05_trend",
    f"""WITH {LOG_SQL}, d AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS n, count(*) FILTER (WHERE semantic_verified) AS v,
        sum(confidence) FILTER (WHERE confidence > 0) AS c, count(*) FILTER (WHERE confidence > 0) AS cn, sum(latency_ms) AS ms FROM v_log GROUP BY 1),
      r AS (SELECT bucket, sum(n) OVER w AS n, sum(v) OVER w AS v, sum(c) OVER w AS c, sum(cn) OVER w AS cn, sum(ms) OVER w AS ms FROM d
        WINDOW w AS (ORDER BY bucket ROWS UNBOUNDED PRECEDING))
    SELECT bucket, CAST(n AS BIGINT) AS samples_processed, CAST(v AS BIGINT) / CAST(n AS DOUBLE) AS verification_rate,
      CAST(c AS DOUBLE) / CAST(cn AS DOUBLE) AS avg_confidence, CAST(n AS BIGINT) / (CAST(ms AS DOUBLE) / 60000.0::DOUBLE) AS throughput FROM r""",
)
def w05(spark, sf):
    return stats.trend(v_log(spark, sf), F.date_format("ts", "yyyy-MM-dd"))


@query("w06_latest", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def w06(spark, sf):
    return table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query(
    "t01_coverage_report",
    """SELECT source, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS percent FROM documents GROUP BY 1""",
)
def t01(spark, sf):
    out = stats.coverage_report(table(spark, sf, "documents"), "source")
    return out.withColumn("percent", F.col("percent").cast("double"))


@query(
    "t02_top_first_reasons",
    f"""WITH {RESULTS_SQL} SELECT substring(rejection_reasons[1], 1, 60) AS reason, count(*) AS n FROM v_results WHERE rejection_reasons IS NOT NULL
    GROUP BY 1 ORDER BY n DESC, reason LIMIT 5""",
)
def t02(spark, sf):
    return stats.top(stats.issue_counts(v_results(spark, sf), "rejection_reasons", 1, 60), "reason", 5)


@query("t03_first_n", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def t03(spark, sf):
    return table(spark, sf, "documents").orderBy("doc_id").limit(50).select("doc_id", "source")


@query("t04_trim_random", "SELECT event_id FROM events ORDER BY md5(event_id || '#11'), event_id LIMIT 1500")
def t04(spark, sf):
    return choose.take_random(table(spark, sf, "events").select("event_id"), "event_id", 11, 1500)


@query("t05_sorted", f"WITH {FORMULAS_SQL} SELECT template_id, nl, event_id FROM v_formulas ORDER BY 1, 2, 3")
def t05(spark, sf):
    return v_formulas(spark, sf).select("template_id", "nl", "event_id").orderBy("template_id", "nl", "event_id")
