"""Duplicates, splits, samples, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog.formulas import PROFILE_SQL, ascii_sql, strip_sql
from pairwright.catalog import replies
from pairwright.catalog.registry import big, joined, query
from pairwright.catalog.views import EVENTS_SQL, _sql_text, events, sql_list, table, v_formulas
from pairwright.functions import rules
from pairwright.functions.profile import formula_profile
from pairwright.functions.text import word_count
from pairwright.operators import choose, generate
from pairwright.operators.identity import first_seen
from pairwright.operators.inference import expression_stage
from pairwright.operators.ranking import dense_index
from pairwright.plans import create, verify
from pairwright.session import spread_rows


def pick_sql(key: str, seed: int, n: str) -> str:
    return f"(CAST(('0x' || substring(md5({key} || '#{seed}'), 1, 8)) AS BIGINT) % ({n}))"


@query(
    "w01_first_seen",
    f"""WITH s AS (SELECT 'documents' AS src, doc_id AS pos, text AS nl FROM documents UNION ALL SELECT 'conversations', conv_id * 1000000 + turn, text FROM conversations),
    h AS (SELECT *, md5({strip_sql('lower(nl)')}) AS h FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY src, pos) AS r, count(*) OVER (PARTITION BY h) AS copies FROM h)
    SELECT src, pos, substring(h, 1, 12) AS id, copies FROM r WHERE r = 1""",
)
def w01(spark, sf):
    from pairwright.functions.identity import statement_hash

    docs = table(spark, sf, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("pos"), F.col("text").alias("nl"))
    conv = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("src"), (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pos"), F.col("text").alias("nl")
    )
    rows = docs.unionByName(conv).select(statement_hash(F.col("nl")).alias("h"), "src", "pos")
    kept = first_seen(rows, "h", F.struct("src", "pos"), copies="copies")
    return kept.select("src", "pos", F.substring("h", 1, 12).alias("id"), "copies")


@query(
    "w01_unique_statements",
    f"""WITH h AS (SELECT *, md5({strip_sql('lower(text)')}) AS h FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY lang, source, doc_id) AS r FROM h)
    SELECT doc_id, lang AS domain, source AS generator, substring(h, 1, 12) AS id FROM r WHERE r = 1""",
)
def w01u(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("domain"), F.col("source").alias("generator"), F.col("text").alias("nl_statement")
    )
    return create.unique_statements(rows, F.struct("domain", "generator", "doc_id")).drop("nl_statement")


@query(
    "w03_halves",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '#3'), doc_id) AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN i <= n // 2 THEN 'model_a' ELSE 'model_b' END AS translator FROM r""",
)
def w03(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id")
    return choose.halves(rows, "doc_id", 3, "translator", F.lit("model_a"), F.lit("model_b"))


@query(
    "w03_verifier_halves",
    """WITH g AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'model_a' ELSE 'model_b' END AS atl_generator FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY atl_generator ORDER BY md5(event_id || '#5'), event_id) AS i, count(*) OVER (PARTITION BY atl_generator) AS n FROM g)
    SELECT event_id, atl_generator, CASE WHEN i <= n // 2 THEN atl_generator WHEN atl_generator = 'model_a' THEN 'model_b' ELSE 'model_a' END AS verifier FROM r""",
)
def w03v(spark, sf):
    maker = F.when(F.pmod("user_id", F.lit(2)) == 0, "model_a").otherwise("model_b")
    rows = table(spark, sf, "events").select("event_id", maker.alias("atl_generator"))
    return verify.assign_verifiers(rows, "event_id", 5, ("model_a", "model_b")).select("event_id", "atl_generator", "verifier")


DOMAINS8 = list(vocab.DOMAIN_WORDS)[:8]
PATTERNS5 = list(vocab.PATTERN_GUIDANCE)


@query(
    "w04_round_robin",
    f"""WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)
    SELECT event_id, event_type, i AS attempt, ({sql_list(DOMAINS8)})[i % 8 + 1] AS domain, ({sql_list(PATTERNS5)})[i % 5 + 1] AS pattern FROM r""",
)
def w04(spark, sf):
    rows = dense_index(table(spark, sf, "events").select("event_id", "event_type"), "event_id", "attempt", ["event_type"])
    return choose.round_robin(rows, "attempt", {"domain": DOMAINS8, "pattern": PATTERNS5})


# generation --------------------------------------------------------------------------------------------------------


def region_domains(spark, sf):
    """Regions as domains, nations as agents and atoms: both tables are fixed, 5 and 25 rows."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    names = F.array_sort(F.collect_list("n_name"))
    phrase = F.map_from_arrays(names, F.transform(names, lambda x: F.concat(x, F.lit(" holds"))))
    return n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("domain")).agg(names.alias("agents"), phrase.alias("atoms"))


FRAMES_SQL = "[" + ", ".join(sql_list(generate.frames_for(s)) for _, _, s in vocab.FORMULA_SHAPES) + "]"
K = "CAST(o_orderkey AS VARCHAR)"
G01_SQL = f"""dom AS (SELECT r_name AS domain, list(n_name ORDER BY n_name) AS agents, row_number() OVER (ORDER BY r_name) - 1 AS no
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
g0 AS (SELECT o_orderkey, {K} AS key, CAST(o_orderkey % 20 AS INTEGER) AS t, {pick_sql(K, 8, '(SELECT count(*) FROM dom)')} AS dno FROM orders),
g1 AS (SELECT g0.*, domain, agents, CAST(len(agents) AS INTEGER) AS n, ({sql_list([s for _, _, s in vocab.FORMULA_SHAPES])})[t + 1] AS shape, ({FRAMES_SQL})[t + 1] AS frames FROM g0 JOIN dom ON no = dno),
g2 AS (SELECT *, {pick_sql('key', 5, 'greatest(n, 1)')} AS a, {pick_sql('key', 6, 'greatest(n - 1, 1)')} + 1 AS step, {pick_sql('key', 7, '2')} AS two,
  (CASE WHEN contains(shape, '{{p}}') THEN 1 ELSE 0 END + CASE WHEN contains(shape, '{{q}}') THEN 1 ELSE 0 END + CASE WHEN contains(shape, '{{r}}') THEN 1 ELSE 0 END) AS holes FROM g1),
g3 AS (SELECT *, list_sort(CASE WHEN n > 1 AND two = 1 THEN [agents[a + 1], agents[(a + step) % n + 1]] ELSE [agents[a + 1]] END) AS members,
  list_transform(list_sort(list_transform(agents, lambda x: {{'o': md5(key || '/' || x || '#9'), 'x': x}})), lambda s: s.x)[1:holes] AS atoms,
  frames[{pick_sql('key', 10, 'len(frames)')} + 1] AS frame FROM g2),
g4 AS (SELECT *, CASE WHEN len(members) = 1 THEN 'the ' || members[1] ELSE 'the ' || members[1] || ' and the ' || members[2] END AS phrase FROM g3),
pairs AS (SELECT o_orderkey, domain AS vocabulary, ({sql_list([t for t, _, _ in vocab.FORMULA_SHAPES])})[t + 1] AS template_id,
  replace(replace(replace(replace(shape, '{{coalition}}', array_to_string(members, ',')), '{{p}}', atoms[1]), '{{q}}', coalesce(atoms[2], '{{q}}')), '{{r}}', coalesce(atoms[3], '{{r}}')) AS formula,
  replace(replace(replace(replace(frame, '{{coalition_nl}}', phrase), '{{p_nl}}', atoms[1] || ' holds'), '{{q_nl}}', coalesce(atoms[2] || ' holds', '{{q_nl}}')), '{{r_nl}}', coalesce(atoms[3] || ' holds', '{{r_nl}}')) AS nl FROM g4)"""


def order_draws(spark, sf):
    return spread_rows(table(spark, sf, "orders").select("o_orderkey"))


@query("g01_template_pairs", f"WITH {G01_SQL} SELECT * FROM pairs")
def g01(spark, sf):
    return generate.base_pairs(order_draws(spark, sf), "o_orderkey", 5, domains=region_domains(spark, sf)).drop("category")


SPACE = [["1"], ["2"], ["3"], ["4"], ["1", "2"], ["1", "3"], ["1", "4"], ["2", "3"], ["2", "4"], ["3", "4"], ["1", "2", "3", "4"], ["robot"], ["driver"]]


@query(
    "g02_coalitions",
    f"""SELECT event_id, array_to_string(([{', '.join(sql_list(c) for c in SPACE)}])[event_id % {len(SPACE)} + 1], ',') AS coalition,
      array_to_string(([{', '.join(sql_list(c) for c in SPACE)}])[{pick_sql('CAST(event_id AS VARCHAR)', 2, str(len(SPACE)))} + 1], ',') AS sampled FROM events""",
)
def g02(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.array_join(generate.coalition_at(i, 4, ["robot", "driver"]), ",").alias("coalition"),
        F.array_join(generate.sample_coalition(i, 2, 4, ["robot", "driver"]), ",").alias("sampled"),
    )


ATOM_NAMES = list(vocab.ATOM_PHRASES)


@query(
    "g03_atoms",
    f"""SELECT event_id, array_to_string(list_transform(list_sort(list_transform({sql_list(ATOM_NAMES)},
      lambda x: {{'o': md5(event_id || '/' || x || '#4'), 'x': x}})), lambda s: s.x)[1:3], ',') AS atoms FROM events""",
)
def g03(spark, sf):
    picked = generate.pick_atoms(generate.default_atoms(), F.col("event_id"), 4, 3)
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(picked, lambda p: p["atom"]), ",").alias("atoms"))


STRATA = """sz AS (SELECT lang, source, count(*) AS size FROM documents GROUP BY 1, 2),
st AS (SELECT lang || '/' || source AS stratum, size, sum(size) OVER () AS total FROM sz),
sh AS (SELECT *, least(137, total) AS n, lead(stratum) OVER (ORDER BY stratum) IS NULL AS is_last, greatest(1, CAST(floor(least(137, total) * (size / CAST(total AS DOUBLE))) AS BIGINT)) AS share FROM st),
us AS (SELECT *, coalesce(sum(least(share, size)) OVER (ORDER BY stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sh),
qt AS (SELECT stratum, CAST(least(CASE WHEN is_last THEN greatest(0, n - used) ELSE share END, size, greatest(0, n - used)) AS BIGINT) AS quota FROM us),
rk AS (SELECT doc_id, lang || '/' || source AS stratum, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '#13'), doc_id) AS r FROM documents)"""


def strata(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("stratum"), "text")


@query("g04_stratified_sample", f"WITH {STRATA} SELECT doc_id, rk.stratum FROM rk JOIN qt ON rk.stratum = qt.stratum WHERE r <= quota")
def g04(spark, sf):
    return choose.stratified_sample(strata(spark, sf).drop("text"), "doc_id", "stratum", 137, 13)


@query("g04_quotas", f"WITH {STRATA} SELECT stratum, quota FROM qt")
def g04q(spark, sf):
    return choose.stratified_quotas(strata(spark, sf), "stratum", 137).select("stratum", "quota")


SPOT_SQL = f"""{PROFILE_SQL}, sp AS (SELECT *, 'src_' || (user_id % 6) AS source FROM pr),
sz AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY source) AS i, count(*) OVER () AS strata, sum(count(*)) OVER () AS total FROM sp GROUP BY source),
sh AS (SELECT *, least(200, total) AS n, greatest(1, CAST(floor(least(200, total) * (size / total::DOUBLE)) AS BIGINT)) AS share FROM sz),
us AS (SELECT *, coalesce(sum(least(share, size)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM sh),
qs AS (SELECT source, least(CASE WHEN i = strata THEN greatest(0, n - used) ELSE share END, size, greatest(0, n - used)) AS quota FROM us),
rs AS (SELECT sp.*, quota, row_number() OVER (PARTITION BY sp.source ORDER BY md5(event_id || '#17'), event_id) AS r FROM sp JOIN qs USING (source))"""


@query(
    "g05_spot_check",
    f"""WITH {SPOT_SQL} SELECT event_id, source, valid AS is_valid, coalesce(depth, 0)::INTEGER AS formula_depth, CASE WHEN valid AND led THEN array_to_string(agents, ',') ELSE '' END AS coalitions,
      CASE WHEN valid THEN array_to_string(list_transform(regexp_extract_all(CASE WHEN led THEN shape ELSE replace(shape, '⟨⟨{{coalition}}⟩⟩', '') END, '⟨⟨|[GFXU¬→∧∨]'),
        lambda x: CASE WHEN x = '⟨⟨' THEN '⟨⟨⟩⟩' ELSE x END), ' ') ELSE '' END AS operators_used,
      CASE WHEN valid THEN least(1.0::DOUBLE, CASE WHEN len(regexp_extract_all(nl, '\\S+')) BETWEEN 5 AND 30 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END + 0.3::DOUBLE
        + CASE WHEN depth BETWEEN 1 AND 4 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END + CASE WHEN led THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) END AS quality_score,
      CASE WHEN valid THEN '' ELSE 'ATL formula failed validation' END AS notes FROM rs WHERE r <= quota""",
)
def g05(spark, sf):
    rows = v_formulas(spark, sf).select("event_id", F.col("nl"), "formula", F.concat(F.lit("src_"), F.pmod("user_id", F.lit(6)).cast("string")).alias("source"))
    chosen = choose.stratified_sample(rows, "event_id", "source", 200, 17)
    p = F.col("p")
    marked = chosen.withColumn("p", formula_profile(F.col("formula")))
    score = F.when(p["valid"], rules.pair_quality(word_count(F.col("nl")), p["depth"], p["top_is_coalition"]))
    return marked.select(
        "event_id", "source", p["valid"].alias("is_valid"), F.coalesce(p["depth"], F.lit(0)).alias("formula_depth"),
        joined(p["coalitions"]).alias("coalitions"), joined(p["symbols"], " ").alias("operators_used"), score.alias("quality_score"),
        F.when(~p["valid"], "ATL formula failed validation").otherwise("").alias("notes"),
    )


@query(
    "g06_train_validation_split",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '#42'), doc_id) AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN i <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'validation' ELSE 'train' END AS split FROM r""",
)
def g06(spark, sf):
    return choose.split_exact(table(spark, sf, "documents").select("doc_id"), "doc_id", 42, 0.1)


@query(
    "g06_split_by_hash",
    f"""SELECT o_orderkey, CASE WHEN {pick_sql(K, 42, '10000')} < 1000 THEN 'validation' ELSE 'train' END AS split FROM orders""",
)
def g06h(spark, sf):
    return choose.split_by_hash(order_draws(spark, sf), "o_orderkey", 42, 0.1)


@query(
    "g07_first_successes",
    f"""WITH {EVENTS_SQL}, a AS (SELECT event_id, user_id, k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS attempt FROM ev),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY attempt) AS kept_no FROM a WHERE attempt < 30 AND k >= 40)
    SELECT event_id, user_id, attempt, CAST(kept_no AS BIGINT) AS kept_no FROM o WHERE kept_no <= 10""",
)
def g07(spark, sf):
    rows = dense_index(events(spark, sf).select("event_id", "user_id", "k"), "event_id", "attempt", ["user_id"])
    return choose.first_successes(rows, "attempt", F.col("k") >= 40, 10, ["user_id"]).drop("k").withColumn("kept_no", big(F.col("kept_no")))


@query(
    "g08_template_dataset",
    f"""WITH {G01_SQL}, a AS (SELECT *, {ascii_sql('formula')} AS f FROM pairs)
    SELECT substring(sha256(lower({strip_sql('nl')}) || '|' || {strip_sql('f')}), 1, 12) AS id, nl AS nl_statement, f AS atl_formula, template_id FROM a""",
)
def g08(spark, sf):
    rows = create.template_dataset(order_draws(spark, sf), "o_orderkey", 5, domains=region_domains(spark, sf))
    return rows.select("id", "nl_statement", "atl_formula", "template_id")


@query(
    "g08_hybrid_dataset",
    f"""WITH {G01_SQL}, a AS (SELECT o_orderkey, nl, {ascii_sql('formula')} AS f FROM pairs),
    p AS (SELECT o_orderkey, nl, f, CAST(NULL AS VARCHAR) AS paraphrase_of FROM a
      UNION ALL SELECT o_orderkey, unnest({replies.paraphrases_sql('nl')}), f, nl FROM a),
    c AS (SELECT * FROM p WHERE NOT starts_with(nl, '{replies.WORDINGS[1]}')),
    r AS (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey || '/' || md5(nl) || '#5'), o_orderkey || '/' || md5(nl)) AS i FROM c)
    SELECT substring(sha256(lower({strip_sql('nl')}) || '|' || {strip_sql('f')}), 1, 12) AS id, nl AS nl_statement, f AS atl_formula, 1.0::DOUBLE AS confidence, paraphrase_of
    FROM r WHERE i <= 5000""",
)
def g08h(spark, sf):
    ask, critique = expression_stage(replies.paraphrases), expression_stage(replies.critique)
    rows = create.hybrid_dataset(order_draws(spark, sf), "o_orderkey", 5, 5000, ask, critique, "mock", domains=region_domains(spark, sf))
    return rows.select("id", "nl_statement", "atl_formula", "confidence", F.col("generation.paraphrase_of").alias("paraphrase_of"))


@query(
    "g09_generator_quota",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN i < n // 2 THEN 'openai' ELSE 'anthropic' END AS generator, printf('sample_%03d', i + 1) AS sample_id FROM r""",
)
def g09(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    rows = dense_index(docs, "doc_id", "i")
    total = docs.agg(F.count(F.lit(1))).scalar()
    return choose.generator_quota(rows, "i", total, ("openai", "anthropic")).drop("i")


@query(
    "j04_template_lookup",
    f"WITH {G01_SQL} SELECT vocabulary, template_id, count(*) AS n, min(formula) AS first_formula FROM pairs GROUP BY 1, 2",
)
def j04(spark, sf):
    pairs = generate.base_pairs(order_draws(spark, sf), "o_orderkey", 5, domains=region_domains(spark, sf))
    return pairs.groupBy("vocabulary", "template_id").agg(F.count(F.lit(1)).alias("n"), F.min("formula").alias("first_formula"))


def two_stage_reply(q, request):
    """Statement requests get one statement that names domain and attempt; translation requests a formula with the attempt, one kind none."""
    domain = F.regexp_extract(q, r"Domain: (\w+)", 1)
    attempt = F.regexp_extract(request, r"/(\d+)", 1)
    statement = F.concat(F.lit('1. "Agents of '), domain, F.lit(" can react in way "), attempt, F.lit('."'))
    bad = F.contains(q, F.lit("Agents of view can"))
    return (
        F.when(F.contains(q, F.lit("No formulas.")), statement).when(bad, F.lit("broken (formula")).otherwise(F.concat(F.lit("⟨⟨1⟩⟩ F way_"), F.regexp_extract(q, r"in way (\d+)", 1)))
    )


@query(
    "g08_model_dataset",
    f"""WITH a AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS attempt FROM events WHERE event_type <> 'view'),
    s AS (SELECT 'Agents of ' || event_type || ' can react in way ' || attempt || '.' AS nl_statement, '<<1>> F way_' || attempt AS atl_formula, 'llm_' || event_type || '_safety' AS template_id FROM a WHERE attempt < 40)
    SELECT substring(sha256(lower(nl_statement) || '|' || atl_formula), 1, 12) AS id, nl_statement, atl_formula, template_id FROM s""",
)
def g08m(spark, sf):
    rows = dense_index(events(spark, sf).select("event_id", "event_type"), "event_id", "attempt", ["event_type"])
    requests = rows.select(
        "attempt", F.col("event_type").alias("domain"), F.array("event_type").alias("agents"), F.array("event_type").alias("atoms"),
        F.lit("safety").alias("pattern"),
    )
    out = create.model_dataset(requests, expression_stage(two_stage_reply, ("request",)), 40, ["domain"], "mock")
    return out.select("id", "nl_statement", "atl_formula", "template_id")
