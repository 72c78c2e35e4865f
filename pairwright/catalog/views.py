"""The four inputs of the registered queries, derived from whole test tables.

Each view exists twice: as a DataFrame and as the SQL of the comparison
engine. All but the conversation pairs are row-wise, so they add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions.formula import fill
from pairwright.functions.text import let, replace_all
from pairwright.operators.neighbours import with_next
from pairwright.session import spread, spread_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spread_rows(table(spark, sf, "events")).withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


SHAPE_TEXTS = [s for _, _, s in vocab.FORMULA_SHAPES]
PLAIN = [("→", "->"), ("¬", "!"), ("∧", "&"), ("∨", "|"), ("⟨⟨", "<<"), ("⟩⟩", ">>")]
LOOSE = [("→", "=>"), ("¬", "~"), ("∧", "/\\"), ("∨", "\\/")]


def v_formulas(spark: SparkSession, sf: str) -> DataFrame:
    """One formula per event in four spellings; some are broken on purpose.

    event_id, user_id, k, template_id, nl, formula
    """
    e = events(spark, sf)
    i, k, u = F.col("event_id"), F.col("k"), F.col("user_id").cast("string")
    no = F.pmod(i, F.lit(20)).cast("int")
    agent = F.concat(F.lit("user_"), u)
    coalition = F.when(
        F.pmod(i, F.lit(3)) == 0, F.concat(agent, F.lit(", unit"), F.pmod(k, F.lit(7)).cast("string"))
    ).otherwise(agent)
    whole = fill(
        F.get(F.array(*[F.lit(s) for s in SHAPE_TEXTS]), no),
        {
            "coalition": coalition, "p": F.col("event_type"),
            "q": F.concat(F.lit("state_"), F.pmod(k, F.lit(10)).cast("string")),
            "r": F.concat(F.lit("goal_"), F.pmod(F.col("user_id"), F.lit(10)).cast("string")),
        },
    )
    kind = F.pmod(k, F.lit(4))

    def respelled(f):
        return F.when(kind == 1, replace_all(f, PLAIN)).when(kind == 2, replace_all(f, LOOSE)).otherwise(f)

    def broken_at_times(f):
        return (
            F.when(k == 11, F.replace(f, F.lit(")"), F.lit("")))
            .when(k == 13, F.concat(F.lit("<<"), agent, F.lit(">> ")))
            .when(k == 17, F.regexp_replace(f, "(⟨⟨|<<)[^⟩>]*(⟩⟩|>>)", ""))
            .when(k == 19, "  ")
            .when(k == 23, F.replace(F.replace(f, F.lit(">>"), F.lit(">")), F.lit("⟩⟩"), F.lit("⟩")))
            .when(k == 29, F.concat(f, F.lit(" and FLAG (x)")))
            .otherwise(f)
        )

    # each step uses the text many times; let() keeps conditions that are pushed through the view small
    broken = let(let(whole, respelled), broken_at_times)
    nl = F.concat(
        F.lit("The user "), u, F.lit(" must react to "), F.col("event_type"), F.lit(" by a message with code "), k.cast("string")
    )
    ids = F.get(F.array(*[F.lit(t) for t, _, _ in vocab.FORMULA_SHAPES]), no)
    return e.select("event_id", "user_id", "event_type", "k", ids.alias("template_id"), nl.alias("nl"), broken.alias("formula"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_replace(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, {_sql_text(a)}, {_sql_text(b)})"
    return x


def sql_list(values) -> str:
    return "[" + ", ".join(_sql_text(v) for v in values) + "]"


EVENTS_SQL = "ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"

FORMULAS_SQL = f"""{EVENTS_SQL},
f0 AS (
  SELECT event_id, user_id, event_type, k, CAST(event_id % 20 AS INTEGER) AS tno,
    'user_' || user_id AS agent,
    CASE WHEN event_id % 3 = 0 THEN 'user_' || user_id || ', unit' || (k % 7) ELSE 'user_' || user_id END AS coalition
  FROM ev),
f1 AS (
  SELECT *, replace(replace(replace(replace(({sql_list(SHAPE_TEXTS)})[tno + 1], '{{coalition}}', coalition),
      '{{p}}', event_type), '{{q}}', 'state_' || (k % 10)), '{{r}}', 'goal_' || (user_id % 10)) AS s FROM f0),
f2 AS (
  SELECT *, CASE k % 4 WHEN 1 THEN {_sql_replace('s', PLAIN)} WHEN 2 THEN {_sql_replace('s', LOOSE)} ELSE s END AS t FROM f1),
v_formulas AS (
  SELECT event_id, user_id, event_type, k,
    ({sql_list([t for t, _, _ in vocab.FORMULA_SHAPES])})[tno + 1] AS template_id,
    'The user ' || user_id || ' must react to ' || event_type || ' by a message with code ' || k AS nl,
    CASE k WHEN 11 THEN replace(t, ')', '')
      WHEN 13 THEN '<<' || agent || '>> '
      WHEN 17 THEN regexp_replace(t, '(⟨⟨|<<)[^⟩>]*(⟩⟩|>>)', '', 'g')
      WHEN 19 THEN '  '
      WHEN 23 THEN replace(replace(t, '>>', '>'), '⟩⟩', '⟩')
      WHEN 29 THEN t || ' and FLAG (x)'
      ELSE t END AS formula
  FROM f2)"""


def v_log(spark: SparkSession, sf: str) -> DataFrame:
    """One verification log row per event; latency and confidence are decimals, so sums are exact."""
    e = events(spark, sf)
    k, i = F.col("k"), F.col("event_id")
    return e.select(
        i.alias("sample_id"),
        F.col("event_type").alias("domain"),
        F.concat(F.lit("model_"), F.pmod("user_id", F.lit(3)).cast("string")).alias("model"),
        (F.col("event_type") != "error").alias("syntax_valid"),
        F.when(k >= 70, True).when(k < 30, False).alias("semantic_verified"),
        (k / F.lit(100.0)).cast("decimal(9,2)").alias("confidence"),
        F.when(F.pmod(k, F.lit(11)) != 0, F.pmod(i, F.lit(7)) != 0).alias("cross_model_agreement"),
        F.pmod(k, F.lit(10)).alias("complexity"),
        (F.col("value") * 10).cast("decimal(18,1)").alias("latency_ms"),
        (k + 50).cast("bigint").alias("prompt_tokens"),
        (k * 2).cast("bigint").alias("completion_tokens"),
        F.when(F.pmod(k, F.lit(13)) == 0, F.concat(F.lit("Error code: "), (k + 400).cast("string"))).alias("error"),
        "ts",
    )


LOG_SQL = f"""{EVENTS_SQL},
v_log AS (
  SELECT event_id AS sample_id, event_type AS domain, 'model_' || (user_id % 3) AS model,
    event_type <> 'error' AS syntax_valid,
    CASE WHEN k >= 70 THEN true WHEN k < 30 THEN false END AS semantic_verified,
    CAST(k / 100.0 AS DECIMAL(9,2)) AS confidence,
    CASE WHEN k % 11 <> 0 THEN event_id % 7 <> 0 END AS cross_model_agreement,
    k % 10 AS complexity,
    CAST(value * 10 AS DECIMAL(18,1)) AS latency_ms,
    CAST(k + 50 AS BIGINT) AS prompt_tokens, CAST(k * 2 AS BIGINT) AS completion_tokens,
    CASE WHEN k % 13 = 0 THEN 'Error code: ' || (k + 400) END AS error, ts
  FROM ev)"""


def v_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels as a sample store."""
    d = table(spark, sf, "documents")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("nl_statement"),
        F.concat(F.lit("<<"), F.col("source"), F.lit(">> G("), F.col("lang"), F.lit(")")).alias("atl_formula"),
        F.col("lang").alias("domain"),
        F.col("source").alias("source_file"),
        (F.col("quality") == 1).alias("syntax_valid"),
        (F.col("toxic") == 1).alias("flagged"),
        "n_chars",
    )


CORPUS_SQL = """v_corpus AS (
  SELECT d.doc_id, d.text AS nl_statement, '<<' || d.source || '>> G(' || d.lang || ')' AS atl_formula,
    d.lang AS domain, d.source AS source_file, l.quality = 1 AS syntax_valid, l.toxic = 1 AS flagged, d.n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def v_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turn and the assistant turn that follows it."""
    c = table(spark, sf, "conversations")
    near = with_next(c, ["conv_id"], "turn", F.floor(F.col("turn") / 10_000), ["role", "text"])
    return near.filter((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("nl"), F.col("next_text").alias("target")
    )


PAIRS_SQL = """v_pairs AS (
  SELECT conv_id, turn, text AS nl, next_text AS target FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def v_results(spark: SparkSession, sf: str) -> DataFrame:
    """Verified and rejected pairs of a run: the formula view with status, verdict and reasons."""
    f = v_formulas(spark, sf)
    k = F.col("k")
    status = F.when(k < 40, "rejected").when(k < 55, "needs_review").otherwise("verified")
    reasons = F.when(
        k < 40,
        F.array(
            F.when(F.pmod(k, F.lit(5)) == 0, F.concat(F.lit("Error code: "), (F.pmod(k, F.lit(4)) + 429).cast("string"), F.lit(" from service")))
            .otherwise(F.concat(F.lit("Wrong operator for "), F.col("event_type"))),
            F.concat(F.lit("Seen with code "), k.cast("string")),
        ),
    )
    return f.select(
        "event_id", "user_id", "k",
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("id"),
        F.col("nl").alias("nl_statement"),
        F.col("formula").alias("atl_formula"),
        F.when(k != 3, F.col("event_type")).alias("domain"),
        F.concat(F.lit("gen_"), F.pmod("user_id", F.lit(2)).cast("string")).alias("atl_generator"),
        F.concat(F.lit("cfg_"), F.pmod("user_id", F.lit(4)).cast("string")).alias("config_name"),
        F.when(k != 5, F.concat(F.lit("ver_"), F.pmod(k, F.lit(2)).cast("string"))).alias("verifier"),
        F.when(k != 7, (k / F.lit(100.0)).cast("decimal(9,2)")).alias("verification_confidence"),
        status.alias("verification_status"),
        reasons.alias("rejection_reasons"),
        F.array(F.concat(F.lit("Verdict code "), k.cast("string"))).alias("verification_notes"),
    )


RESULTS_SQL = f"""{FORMULAS_SQL},
v_results AS (
  SELECT event_id, user_id, k, 's' || event_id AS id, nl AS nl_statement, formula AS atl_formula,
    CASE WHEN k <> 3 THEN event_type END AS domain,
    'gen_' || (user_id % 2) AS atl_generator, 'cfg_' || (user_id % 4) AS config_name,
    CASE WHEN k <> 5 THEN 'ver_' || (k % 2) END AS verifier,
    CASE WHEN k <> 7 THEN CAST(k / 100.0 AS DECIMAL(9,2)) END AS verification_confidence,
    CASE WHEN k < 40 THEN 'rejected' WHEN k < 55 THEN 'needs_review' ELSE 'verified' END AS verification_status,
    CASE WHEN k < 40 THEN [CASE WHEN k % 5 = 0 THEN 'Error code: ' || (k % 4 + 429) || ' from service'
        ELSE 'Wrong operator for ' || event_type END, 'Seen with code ' || k] END AS rejection_reasons,
    ['Verdict code ' || k] AS verification_notes
  FROM v_formulas)"""
