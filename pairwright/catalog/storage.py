"""Readers and sinks: data is written to the shared folder by Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog.formulas import strip_sql
from pairwright.catalog.registry import big, query
from pairwright.catalog.views import (
    CORPUS_SQL, EVENTS_SQL, FORMULAS_SQL, LOG_SQL, PAIRS_SQL, RESULTS_SQL, _sql_text, documents, events, table, v_corpus, v_formulas, v_log, v_pairs,
    v_results,
)
from pairwright.plans import compare, training
from pairwright.session import run_dir
from pairwright.sinks import writers
from pairwright.sources import blocks, readers

STORED_SQL = f"""{CORPUS_SQL}, stored AS (SELECT 'd' || doc_id AS id, nl_statement, atl_formula, domain, source_file, syntax_valid FROM v_corpus)"""
STORED = ["id", "nl_statement", "atl_formula", "domain", "source_file", "syntax_valid"]


def stored(spark, sf):
    return v_corpus(spark, sf).withColumn("id", F.concat(F.lit("d"), F.col("doc_id").cast("string"))).select(*STORED)


@query("s01_jsonl", f"WITH {STORED_SQL} SELECT * FROM stored")
def s01(spark, sf):
    path = run_dir(spark, "s01") + "/samples.jsonl"
    writers.write_jsonl(stored(spark, sf), path)
    return readers.read_jsonl(spark, path).select(*STORED)


@query(
    "s02_jsonl_broken_lines",
    f"""WITH {STORED_SQL} SELECT id, CAST(NULL AS VARCHAR) AS line FROM stored UNION ALL SELECT NULL, '{{"id": "' || doc_id || '", oops' FROM labels""",
)
def s02(spark, sf):
    path = run_dir(spark, "s02")
    writers.write_jsonl(stored(spark, sf), path)
    broken = F.concat(F.lit('{"id": "'), F.col("doc_id").cast("string"), F.lit('", oops'))
    table(spark, sf, "labels").select(F.explode(F.array(broken, F.lit("   ")))).write.mode("append").text(path)
    good, bad = readers.read_jsonl_lenient(spark, path)
    return good.select("id").unionByName(bad.select("line"), allowMissingColumns=True)


@query(
    "s02_line_counts",
    """SELECT CAST((SELECT count(*) FROM documents) AS BIGINT) AS good, CAST((SELECT count(*) FROM labels) AS BIGINT) AS broken, true AS counted""",
)
def s02c(spark, sf):
    path = run_dir(spark, "s02") + "/all.jsonl"
    writers.write_jsonl(stored(spark, sf), path)
    broken = F.concat(F.lit('{"id": "'), F.col("doc_id").cast("string"), F.lit('", oops'))
    table(spark, sf, "labels").select(broken).write.mode("append").text(path)
    counts = readers.line_counts(spark, [path]).agg(F.sum("good").alias("good"), F.sum("broken").alias("broken"))
    # rows can be counted as they are, with the rejects beside them
    n = readers.read_samples(spark, [path]).agg(F.count(F.lit(1)).alias("n"))
    m = readers.read_rejects(spark, [path]).agg(F.count(F.lit(1)).alias("m"))
    return counts.join(n, F.col("good") == F.col("n"), "left").join(m, F.col("broken") == F.col("m"), "left").select(
        "good", "broken", (F.col("n").isNotNull() & F.col("m").isNotNull()).alias("counted")
    )


@query("s03_json_documents", f"WITH {STORED_SQL} SELECT id, domain, atl_formula FROM stored")
def s03(spark, sf):
    path = run_dir(spark, "s03")
    item = F.struct("id", F.col("nl_statement").alias("nl"), F.col("atl_formula").alias("atl"), "domain")
    shape = F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3))
    text = (
        F.when(shape == 0, F.to_json(F.struct(F.array(item).alias("samples"))))
        .when(shape == 1, F.to_json(F.struct(F.array(item).alias("pairs"))))
        .otherwise(F.to_json(F.array(item)))
    )
    stored(spark, sf).select(text.alias("value")).write.text(path)
    return readers.read_json_document(spark, path, one_per_line=True).select("id", "domain", "atl_formula")


@query("s03_large_lists", f"WITH {STORED_SQL} SELECT id, domain, atl_formula FROM stored")
def s03l(spark, sf):
    """Four files or more with one list each, an element on a line."""
    path = run_dir(spark, "s03l")
    write_lists(stored(spark, sf), path)
    return readers.read_large_json(spark, path).where("id <> 'none'").select("id", "domain", "atl_formula")


#: A file is written by one task, so there are as many lists as the statements have such pieces, four at least.
LIST_BYTES = 128 << 20


def write_lists(samples, path, list_bytes=LIST_BYTES):
    spark = samples.sparkSession
    size = samples.agg(F.sum(F.octet_length("nl_statement").cast("bigint"))).first()[0] or 0
    lists = max(4, -(-size // list_bytes))
    item = F.concat(F.lit(", "), F.to_json(F.struct("id", F.col("nl_statement").alias("nl"), F.col("atl_formula").alias("atl"), "domain")))
    lines = samples.select(F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(lists)).cast("int").alias("doc"), F.lit(1).alias("place"), item.alias("value"))
    for place, text in ((0, '{"about": {"kind": "pairs"}, "samples": [{"id": "none"}'), (2, "]}")):
        lines = lines.unionByName(spark.range(lists).select(F.col("id").cast("int").alias("doc"), F.lit(place).alias("place"), F.lit(text).alias("value")))
    # a few partitions a list, so that few lists share one
    lines.repartition(4 * lists, "doc").sortWithinPartitions("doc", "place").drop("place").write.partitionBy("doc").text(path)


@query("s04_many_sources", f"WITH {STORED_SQL} SELECT id, nl_statement FROM stored UNION ALL SELECT 'e' || event_id, event_type FROM events")
def s04(spark, sf):
    root = run_dir(spark, "s04")
    writers.write_jsonl(stored(spark, sf), f"{root}/a.jsonl")
    ev = table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("sample_id"), F.col("event_type").alias("nl")
    )
    writers.write_jsonl(ev, f"{root}/b.jsonl")
    return readers.read_samples(spark, [f"{root}/a.jsonl", f"{root}/b.jsonl"]).select("id", "nl_statement")


# text files --------------------------------------------------------------------------------------------------------


def block_text(shape: int):
    """A document as a text block of one of the three formats: a formula after every sentence that ends a line."""
    t, body = F.col("text"), F.concat(F.lit("<<"), F.col("source"), F.lit(">> G("), F.col("lang"), F.lit(")"))
    tail = F.concat(F.lit("<<"), F.col("source"), F.lit(">> F("), F.col("lang"), F.lit(")"))
    bare = F.replace(t, F.lit('"'), F.lit(""))
    if shape == 3:
        return F.replace(t, F.lit(".\n"), F.concat(F.lit(".\n"), body, F.lit("\n")))
    if shape == 1:
        inner = F.replace(bare, F.lit(".\n"), F.concat(F.lit('."\n'), body, F.lit('\n"')))
        return F.concat(F.lit('"'), inner, F.lit('"\n'), tail)
    inner = F.replace(bare, F.lit(".\n"), F.concat(F.lit('." -> '), body, F.lit('\n"')))
    return F.concat(F.lit('"'), inner, F.lit('" -> '), tail)


NL = "chr(10)"
BODY, TAIL = "'<<' || source || '>> G(' || lang || ')'", "'<<' || source || '>> F(' || lang || ')'"
BLOCK_SQL = {
    3: f"replace(text, '.' || {NL}, '.' || {NL} || {BODY} || {NL})",
    1: f"""'"' || replace(replace(text, '"', ''), '.' || {NL}, '."' || {NL} || {BODY} || {NL} || '"') || '"' || {NL} || {TAIL}""",
    2: f"""'"' || replace(replace(text, '"', ''), '.' || {NL}, '." -> ' || {BODY} || {NL} || '"') || '" -> ' || {TAIL}""",
}
FILES_SQL = f"""files AS (SELECT 'doc_' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS file,
  CASE CAST(n_chars % 3 AS INTEGER) WHEN 0 THEN {BLOCK_SQL[3]} WHEN 1 THEN {BLOCK_SQL[1]} ELSE {BLOCK_SQL[2]} END AS text FROM documents)"""
FORMAT_SQL = """CASE WHEN regexp_matches(text, '"[^"]+"\\s*\\n\\s*(<<|⟨⟨)') THEN 1 WHEN regexp_matches(text, '"[^"]+"\\s*->\\s*[⟨<]') THEN 2 ELSE 3 END"""
LINES_SQL = f"list_transform(string_split({strip_sql('text')}, chr(10)), lambda x: {strip_sql('x')})"
OPENS = "(starts_with({0}, '<<') OR starts_with({0}, '⟨⟨'))"


def pairs_sql(source: str, key: str) -> str:
    """Plain, quoted and same-line pairs of a table with columns key and text, by detected format."""
    same = """'"([^"]+)"\\s*->\\s*(<<[^>]*>> [GF]\\([a-z]*\\))'"""
    return f"""fm AS (SELECT {key}, text, {FORMAT_SQL} AS fmt FROM {source}),
ln AS (SELECT {key}, fmt, {LINES_SQL} AS lines FROM fm WHERE fmt <> 2),
nx AS (SELECT {key}, fmt, lines, unnest(generate_series(1, len(lines) - 1)) AS i FROM ln),
lp AS (SELECT {key}, fmt, i - 1 AS pos, lines[i] AS nl, lines[i + 1] AS formula FROM nx),
sl AS (SELECT {key}, regexp_extract_all(text, {same}, 1) AS ns, regexp_extract_all(text, {same}, 2) AS fs FROM fm WHERE fmt = 2),
s2 AS (SELECT {key}, unnest(generate_series(1, len(ns))) AS i, ns, fs FROM sl),
parsed AS (
  SELECT {key}, pos, nl, formula FROM lp WHERE fmt = 3 AND nl <> '' AND NOT regexp_matches(nl, '^(#|❌|Interpreting)') AND NOT {OPENS.format('nl')} AND {OPENS.format('formula')}
  UNION ALL SELECT {key}, pos, {strip_sql("regexp_replace(nl, '^" + chr(34) + "|" + chr(34) + "$', '', 'g')")}, formula FROM lp
    WHERE fmt = 1 AND starts_with(nl, '"') AND ends_with(nl, '"') AND {OPENS.format('formula')}
  UNION ALL SELECT {key}, i - 1, {strip_sql('ns[i]')}, {strip_sql('fs[i]')} FROM s2)"""


def files(spark, sf):
    n = F.pmod("n_chars", F.lit(3))
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    text = F.when(n == 0, block_text(3)).when(n == 1, block_text(1)).otherwise(block_text(2))
    return documents(spark, sf).select(name.alias("file"), text.alias("text"))


@query(
    "s05_text_blocks",
    f"""WITH f3 AS (SELECT doc_id, {BLOCK_SQL[3]} AS text FROM documents), {pairs_sql('f3', 'doc_id')}
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, nl, formula FROM parsed""",
)
def s05(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(blocks.plain_pairs(block_text(3))).alias("p"))
    return rows.select("doc_id", big(F.col("p.pos")).alias("pos"), "p.nl", "p.formula")


@query(
    "s05_line_files",
    f"""WITH f3 AS (SELECT doc_id, {BLOCK_SQL[3]} AS text FROM documents), {pairs_sql('f3', 'doc_id')}
    SELECT nl, formula, count(*) AS n FROM parsed GROUP BY 1, 2""",
)
def s05l(spark, sf):
    path = run_dir(spark, "s05")
    lines = documents(spark, sf).select(F.explode(F.split(block_text(3), "\n")).alias("value"))
    lines.write.text(path)
    pairs = blocks.pair_line_table(blocks.read_lines(spark, path), ["file"], "pos", "line")
    return pairs.groupBy("nl", "formula").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s06_same_line_blocks",
    f"""WITH f2 AS (SELECT doc_id, {BLOCK_SQL[2]} AS text FROM documents), {pairs_sql('f2', 'doc_id')}
    SELECT doc_id, CAST(pos AS BIGINT) AS pos, nl, formula FROM parsed""",
)
def s06(spark, sf):
    rows = documents(spark, sf).select("doc_id", F.explode(blocks.same_line_pairs(block_text(2))).alias("p"))
    return rows.select("doc_id", big(F.col("p.pos")).alias("pos"), "p.nl", "p.formula")


@query("s07_text_format", f"WITH {FILES_SQL} SELECT file, CAST({FORMAT_SQL} AS BIGINT) AS fmt FROM files")
def s07(spark, sf):
    return files(spark, sf).select("file", big(blocks.text_format(F.col("text"))).alias("fmt"))


@query(
    "s08_load_texts",
    f"""WITH {FILES_SQL}, {pairs_sql('files', 'file')},
    h AS (SELECT file, pos, substring(sha256(lower({strip_sql('nl')}) || '|' || formula), 1, 12) AS id FROM parsed),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, pos) = 1 AS is_first FROM h)
    SELECT file, count(*) FILTER (WHERE is_first) AS added, count(*) FILTER (WHERE NOT is_first) AS duplicates FROM r GROUP BY 1""",
)
def s08(spark, sf):
    return blocks.load_texts(files(spark, sf))[1]


@query(
    "s08_folder_report",
    f"""WITH f3 AS (SELECT doc_id, {BLOCK_SQL[3]} AS text FROM documents), {pairs_sql('f3', 'doc_id')},
    h AS (SELECT substring(sha256(lower({strip_sql('nl')}) || '|' || formula), 1, 12) AS id FROM parsed)
    SELECT 'loaded' AS outcome, count(DISTINCT id) AS added, count(*) - count(DISTINCT id) AS duplicates FROM h UNION ALL SELECT 'undecodable', 0, 0""",
)
def s08r(spark, sf):
    """Files of many blocks, and one that is not UTF-8."""
    path = run_dir(spark, "s08r")
    text = documents(spark, sf).select(block_text(3).alias("value"))
    text.repartition(32).write.text(path)
    broken = spark.range(1).select(F.concat(F.unhex(F.lit("ff")).cast("string"), F.lit("x\n<<a>> G p")).alias("value"))
    broken.write.mode("append").text(path)
    report = blocks.load_folder(spark, path)[1]
    return report.where("outcome <> 'no_pairs'").groupBy("outcome").agg(F.sum("added").alias("added"), F.sum("duplicates").alias("duplicates"))


@query(
    "s09_statements",
    f"""WITH l AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))
    SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, {strip_sql('lines[i]')} AS nl_statement FROM l WHERE {strip_sql('lines[i]')} <> ''""",
)
def s09(spark, sf):
    rows = readers.split_statements(documents(spark, sf).select("doc_id", "text"), "text")
    return rows.withColumn("pos", big(F.col("pos")))


@query(
    "s11_old_spellings",
    f"""WITH {FORMULAS_SQL} SELECT CASE WHEN k % 2 = 0 THEN 'a' || event_id ELSE 'b' || event_id END AS id, nl AS nl_statement, formula AS atl_formula,
      CASE WHEN k % 5 = 0 THEN event_type ELSE 'generic' END AS domain, template_id, 'file_' || user_id AS source_file FROM v_formulas""",
)
def s11(spark, sf):
    k, i = F.pmod("k", F.lit(3)), F.col("event_id").cast("string")
    even = F.pmod("k", F.lit(2)) == 0
    old = v_formulas(spark, sf).select(
        F.when(even, F.concat(F.lit("a"), i)).alias("id"), F.when(~even, F.concat(F.lit("b"), i)).alias("sample_id"),
        F.when(k == 0, F.col("nl")).alias("nl_statement"), F.when(k == 1, F.col("nl")).alias("nl_text"), F.when(k == 2, F.col("nl")).alias("nl"),
        F.when(even, F.col("formula")).alias("atl_formula"), F.when(~even, F.col("formula")).alias("atl"),
        F.when(F.pmod("k", F.lit(5)) == 0, F.col("event_type")).alias("domain"), "template_id",
        F.concat(F.lit("file_"), F.col("user_id").cast("string")).alias("source"), F.lit(1).alias("unknown_field"),
    )
    return readers.unify(old).select("id", "nl_statement", "atl_formula", "domain", "template_id", "source_file")


@query(
    "s12_assign_ids",
    """SELECT conv_id * 1000000 + turn AS pos, CASE WHEN role = 'user' THEN 'u' || conv_id || '_' || turn
      ELSE printf('loaded_%04d', row_number() OVER (ORDER BY conv_id, turn) - 1) END AS sample_id FROM conversations""",
)
def s12(spark, sf):
    c = table(spark, sf, "conversations")
    own = F.concat_ws("_", F.concat(F.lit("u"), F.col("conv_id").cast("string")), F.col("turn").cast("string"))
    rows = c.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("pos"), F.when(F.col("role") == "user", own).alias("sample_id"))
    return readers.assign_ids(rows, "pos")


@query(
    "w02_pair_next_line",
    f"WITH {PAIRS_SQL} SELECT conv_id, turn, nl, target FROM v_pairs",
)
def w02(spark, sf):
    return v_pairs(spark, sf)


# sinks -------------------------------------------------------------------------------------------------------------


@query("k01_jsonl_sink", f"WITH {STORED_SQL} SELECT id, syntax_valid IS NOT NULL AS has_field FROM stored")
def k01(spark, sf):
    path = run_dir(spark, "k01")
    writers.write_dataset(stored(spark, sf), path, "jsonl")
    line = F.col("value")
    return spark.read.text(path).select(
        F.regexp_extract(line, r'^\{"id":"([^"]*)"', 1).alias("id"), F.regexp_like(line, F.lit(r'"syntax_valid":(true|false)\}$')).alias("has_field")
    )


@query(
    "k02_csv_sink",
    f"""WITH {FORMULAS_SQL} SELECT 'e' || event_id AS id, nl AS nl_statement, event_type || ',' || template_id AS agents, template_id,
      k % 2 = 0 AS syntax_valid, k / 4.0::DOUBLE AS confidence FROM v_formulas""",
)
def k02(spark, sf):
    path = run_dir(spark, "k02")
    some = F.array("event_type", "template_id")
    rows = v_formulas(spark, sf).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("nl").alias("nl_statement"), F.col("formula").alias("atl_formula"),
        F.col("formula").alias("atl_unicode"), F.col("event_type").alias("domain"), "template_id", some.alias("agents"), some.alias("operators"),
        some.alias("atoms"), (F.pmod("k", F.lit(2)) == 0).alias("syntax_valid"), (F.col("k") / 4.0).alias("confidence"),
    )
    writers.write_dataset(rows, path, "csv")
    schema = ", ".join(f"{c} {'boolean' if c == 'syntax_valid' else 'double' if c == 'confidence' else 'string'}" for c in writers.CSV_COLUMNS)
    back = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    return back.select("id", "nl_statement", "agents", "template_id", "syntax_valid", "confidence")


@query(
    "k03_metrics_csv",
    f"""WITH {LOG_SQL} SELECT sample_id, domain, syntax_valid, semantic_verified, CAST(confidence AS DOUBLE) AS confidence, cross_model_agreement,
      CAST(complexity AS BIGINT) AS complexity, CAST(latency_ms AS DOUBLE) AS latency_ms, prompt_tokens, completion_tokens FROM v_log""",
)
def k03(spark, sf):
    path = run_dir(spark, "k03")
    writers.write_metrics_csv(v_log(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), path)
    schema = (
        "sample_id bigint, domain string, syntax_valid boolean, semantic_verified boolean, confidence double, cross_model_agreement boolean, "
        "complexity bigint, latency_ms double, prompt_tokens bigint, completion_tokens bigint, timestamp string"
    )
    return spark.read.schema(schema).option("header", True).csv(path).drop("timestamp")


@query(
    "k04_run_directory",
    f"""WITH {RESULTS_SQL} SELECT 'samples' AS part, count(*) AS n FROM v_results UNION ALL SELECT 'reasons', sum(n)::BIGINT FROM (
      SELECT count(*) AS n FROM (SELECT unnest(rejection_reasons) AS r FROM v_results) GROUP BY substring(r, 1, 100))""",
)
def k04(spark, sf):
    from pairwright.operators import stats

    rows = v_results(spark, sf)
    reasons = stats.issue_counts(rows, "rejection_reasons")
    paths = writers.write_run(rows, {"reasons": reasons}, run_dir(spark, "k04"), "r1")
    n = spark.read.parquet(paths["samples"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("samples").alias("part"), "n")
    m = spark.read.schema("reason string, n bigint").json(paths["reasons"]).agg(F.sum("n").alias("n")).select(F.lit("reasons").alias("part"), "n")
    return n.unionByName(m)


@query(
    "k05_routed_output",
    f"WITH {RESULTS_SQL} SELECT verification_status, count(*) AS n, min(id) AS first_id FROM v_results GROUP BY 1",
)
def k05(spark, sf):
    path = run_dir(spark, "k05")
    writers.write_routed(v_results(spark, sf), path)
    return spark.read.parquet(path).groupBy("verification_status").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


ROUTED_SQL = """SELECT verification_status AS route, count(*) AS n, CAST(sum(verification_confidence) AS DOUBLE) AS confidence_sum, count(verification_confidence) AS confidence_count,
  CAST(sum(length(nl_statement)) AS DOUBLE) AS chars_sum, count(nl_statement) AS chars_count FROM v_results GROUP BY 1"""


@query("k05_routed_stats", f"WITH {RESULTS_SQL} {ROUTED_SQL}")
def k05s(spark, sf):
    path = run_dir(spark, "k05s")
    measures = {"confidence": F.col("verification_confidence"), "chars": F.char_length("nl_statement")}
    writers.write_routed(v_results(spark, sf), f"{path}/rows", stats=f"{path}/stats", measures=measures)
    kinds = "route string, n long, confidence_sum double, confidence_count long, chars_sum double, chars_count long"
    return spark.read.schema(kinds).json(f"{path}/stats")


@query(
    "k06_by_domain",
    f"""WITH {FORMULAS_SQL} SELECT event_type AS domain, nl AS nl_statement, count(*) OVER (PARTITION BY event_type) AS domain_count FROM v_formulas""",
)
def k06(spark, sf):
    rows = v_formulas(spark, sf).select(F.col("event_type").alias("domain"), F.col("nl").alias("nl_statement"))
    return writers.by_domain(rows).select("domain", "nl_statement", "domain_count")


@query(
    "k07_train_validation_files",
    f"""WITH {CORPUS_SQL}, u AS (SELECT doc_id, {_sql_text(vocab.TRAINING_REQUEST)} || chr(10) || chr(10) || nl_statement || chr(10) || chr(10) || 'Domain: ' || domain AS said
      FROM v_corpus WHERE length(nl_statement) >= 10 AND length(atl_formula) >= 3),
    r AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || '#42'), doc_id) AS i, count(*) OVER () AS n FROM u)
    SELECT CASE WHEN i <= greatest(1, CAST(floor(n * 0.1::DOUBLE) AS BIGINT)) THEN 'validation' ELSE 'train' END AS split, count(*) AS rows,
      CAST(3 AS BIGINT) AS messages, min(md5(said)) AS first_statement, sum(length(said))::BIGINT AS chars FROM r GROUP BY 1""",
)
def k07(spark, sf):
    path = run_dir(spark, "k07")
    none = F.lit(None)
    rows = v_corpus(spark, sf).select(
        "doc_id", "domain", "nl_statement", "atl_formula", none.cast("double").alias("verification_confidence"), none.cast("string").alias("verification_status")
    )
    split = training.training_split(training.mark_rows(rows), "doc_id", 42)
    writers.write_split(training.chat_records(split, include_agents=False), path)
    back = spark.read.schema("messages array<struct<role:string,content:string>>, split string").json(path)
    said = F.col("messages")[1]["content"]
    return back.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), big(F.min(F.size("messages"))).alias("messages"), F.min(F.md5(said)).alias("first_statement"), big(F.sum(F.length(said))).alias("chars")
    )


@query(
    "k09_comparison_outputs",
    f"""WITH {LOG_SQL} SELECT sample_id, model, CAST(latency_ms AS DOUBLE) AS response_time, CAST(NULL AS BOOLEAN) AS correct FROM v_log""",
)
def k09(spark, sf):
    from pairwright.operators import stats

    path = run_dir(spark, "k09")
    long = v_log(spark, sf).select(
        "sample_id", "model", F.col("latency_ms").cast("double").alias("response_time"),
        (F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens_used"), "syntax_valid", "error",
    )
    writers.write_comparison(long, compare.review_rows(long), stats.model_stats(long), path)
    return spark.read.schema("sample_id bigint, model string, response_time double, correct boolean").json(f"{path}/review")


@query(
    "p14_review_rows",
    f"""WITH {EVENTS_SQL} SELECT event_id, 'a' AS model, round_even(value / 7, 3) AS response_time FROM ev
    UNION ALL SELECT event_id, 'b', round_even(value / 3, 3) FROM ev""",
)
def p14(spark, sf):
    def t(x):
        return F.struct(x.alias("response_time"))

    m = F.create_map(F.lit("a"), t(F.col("value") / 7), F.lit("b"), t(F.col("value") / 3))
    rows = events(spark, sf).select("event_id", compare.review_map(m).alias("translations"))
    return readers.translations_long(rows)
