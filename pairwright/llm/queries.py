"""The registered query of each operator: production parameters, whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.catalog.registry import query
from pairwright.llm import (
    chat_format, decontamination, host_reputation, lm_scoring, mixing, near_duplicates, periodic_runs, quality, substring_dedup, token_alignment,
    token_counts, vector_join, warc_revisit,
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- 1: revisits ----------------------------------------------------------------------------------------------------
# Every page is a full response, and a minute later a revisit of the same url in another spelling. By the page's
# number the revisit's validators agree, differ or are missing, or it is dated before the response.


def captures(pages: DataFrame) -> DataFrame:
    k = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce(F.col("html"), F.lit(""))), F.lit('"'))
    then = F.timestamp_seconds(F.lit(1_600_000_000) + k * 600)

    def h(**named):
        return F.array(*[F.struct(F.lit(n.replace("_", "-")).alias("name"), v.cast("string").alias("value")) for n, v in named.items()])

    full = pages.select(
        (2 * k).alias("record_id"), F.lit("response").alias("kind"), "url", then.alias("date"), F.lit(200).alias("status"),
        h(Content_Type=F.lit("text/html"), Content_Length=F.octet_length("html"), ETag=tag, Cache_Control=F.lit("max-age=60")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.col("html").alias("body"),
    )
    seen = F.when(k % 11 == 0, F.lit('"other"')).when(k % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    plain = h(cache_control=F.lit("max-age=120"), content_length=F.lit(0), X_Seen=k)
    again = pages.select(
        (2 * k + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat(F.lit("HTTPS://www."), F.regexp_replace("url", r"^[a-z]+://(www\.)?", ""), F.lit("#again")).alias("url"),
        F.when(k % 17 == 0, then - F.expr("INTERVAL 1 MINUTE")).otherwise(then + F.expr("INTERVAL 1 MINUTE")).alias("date"), F.lit(304).alias("status"),
        F.when(k % 13 == 0, plain).otherwise(F.concat(plain, F.array(F.struct(F.lit("etag").alias("name"), seen.alias("value"))))).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("string").alias("body"),
    )
    return full.unionByName(again)


CANONICAL_SQL = r"""
  CASE WHEN url IS NULL THEN NULL ELSE regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^www\.', ''), ':(80|443)?$', '')
    || CASE WHEN regexp_extract(bare, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(bare, '^[^/?]*([^?]*)', 1) END
    || CASE WHEN regexp_extract(bare, '\?(.*)$', 1) = '' THEN ''
       ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') END END
"""


@query("op1_warc_revisit", rf"""
WITH p AS (
  SELECT page_id AS k, url, html, 1600000000 + page_id * 600 AS t, '"' || md5(coalesce(html, '')) || '"' AS tag,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
), c AS (SELECT *, {CANONICAL_SQL} AS url_key FROM p),
r AS (SELECT 2 * k + 1 AS record_id, k, url_key, t + CASE WHEN k % 17 = 0 THEN -60 ELSE 60 END AS t,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN '"other"' ELSE tag END AS tag FROM c),
m AS (SELECT r.record_id, r.k, r.url_key, r.tag, max_by(struct_pack(id := 2 * c.k, tag := c.tag, html := c.html), c.t) AS f
  FROM r LEFT JOIN c ON c.url_key = r.url_key AND c.t < r.t GROUP BY ALL),
o AS (SELECT *, CASE WHEN f IS NULL THEN 'no_response' WHEN tag IS NULL THEN 'no_validator' WHEN tag = f.tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM m)
SELECT record_id, url_key, outcome, f.id AS response_id,
  CASE WHEN outcome = 'resolved' THEN 'Content-Type: text/html' || chr(10) || 'Content-Length: ' || coalesce(strlen(f.html)::VARCHAR, '') || chr(10)
    || 'cache-control: max-age=120' || chr(10) || 'X-Seen: ' || k || chr(10) || 'etag: ' || CASE WHEN k % 3 = 0 THEN 'W/' ELSE '' END || tag END AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(f.html) END AS body_sha256
FROM o
""")
def op1_warc_revisit(spark: SparkSession, sf: str) -> DataFrame:
    out = warc_revisit.resolve(captures(table(spark, sf, "pages")))
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), F.coalesce(h["value"], F.lit(""))))
    return out.select("record_id", "url_key", "outcome", "response_id", F.array_join(lines, "\n").alias("headers"), F.sha2("body", 256).alias("body_sha256"))


# --- 2: token counts ------------------------------------------------------------------------------------------------


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


# --- 3: mixing ------------------------------------------------------------------------------------------------------


@query("op3_mixing", """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS z, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source
), levels(n, level, fixed) AS (
  SELECT 0, 0.0::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT n + 1, (1.5 * t.total - t.spent) / t.open_w, t.full_n FROM (
    SELECT l.n, l.fixed, (SELECT count(*) FROM s WHERE w * l.level >= 2 * z) AS full_n, (SELECT coalesce(sum(w), 0) FROM s WHERE NOT w * l.level >= 2 * z) AS open_w,
      (SELECT coalesce(sum(2 * z), 0) FROM s WHERE w * l.level >= 2 * z) AS spent, (SELECT sum(z) FROM s) AS total FROM levels l) t
  WHERE t.full_n <> t.fixed AND t.open_w > 0
), tg AS (
  SELECT source, z, least(w * (SELECT level FROM levels ORDER BY n DESC LIMIT 1), 2 * z) AS target FROM s
), p AS (
  SELECT *, CASE WHEN z > 0 THEN floor(target / z) ELSE 0 END AS rounds FROM tg
), g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY ALL),
a AS (SELECT g.source, h, n, sum(n) OVER (PARTITION BY g.source ORDER BY h) - n AS before, target - rounds * z AS rest FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
t AS (SELECT source, max(h) AS last FROM a WHERE before + n <= rest OR (before <= rest AND before + n - rest < rest - before) GROUP BY source)
SELECT d.doc_id, d.size, p.z::BIGINT AS source_size, p.target, (d.size * (p.rounds + CASE WHEN d.h <= t.last THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
""")
def op3_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# --- 4: decontamination ---------------------------------------------------------------------------------------------


@query("op4_decontamination", """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, n, item FROM dw JOIN bw USING (g)),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
""")
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    hit = F.coalesce(F.aggregate("found_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]), F.lit(0).cast("long"))
    return found.select(
        "doc_id", F.col("found_words").alias("n_words"), hit.alias("n_hit"), F.size("found_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


# --- 5: chat formatting ---------------------------------------------------------------------------------------------

CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op5_chat_format", rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), e AS (SELECT *, regexp_replace(text, '<(\\*\|)', '<\\\1', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(esc) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op5_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_format.digests(chat_format.format_chats(turns))


# --- 6: substring dedup ---------------------------------------------------------------------------------------------


@query("op6_substring_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, doc_id, i, list_slice(w, i, i + 12) AS x FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT x, min(doc_id) AS low FROM g GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS i FROM g JOIN m USING (x) WHERE low < coalesce(doc_id, 9223372036854775807)),
k AS (SELECT d.r, u.i, u.x FROM d, LATERAL (SELECT unnest(d.w) AS x, unnest(range(1, len(d.w) + 1)) AS i) u),
s AS (SELECT k.r, string_agg(k.x, ' ' ORDER BY k.i) FILTER (gone.r IS NULL) AS kept, count(gone.r) AS n FROM k LEFT JOIN gone ON k.r = gone.r AND k.i = gone.i GROUP BY k.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
""")
def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("all_words").alias("n_words"), F.col("cut_words").alias("n_removed"), F.sha2("kept_words", 256).alias("kept_sha256"))


# --- 7: quality -----------------------------------------------------------------------------------------------------


@query("op7_quality")
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


# --- 8: urls --------------------------------------------------------------------------------------------------------

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@query("op8_url_reputation", """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
lab AS (SELECT host, regexp_replace(string_split(host, '@')[-1], ':[0-9]*\\z', '') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM p LEFT JOIN l USING (page_id) GROUP BY host),
x AS (SELECT *, string_split(name, '.') AS x, regexp_matches(name, '\\A([0-9]+\\.){3}[0-9]+\\z') OR starts_with(name, '[') AS address,
  array_to_string(x[-2:], '.') IN ('ac.uk', 'co.jp', 'co.kr', 'co.nz', 'co.uk', 'co.za', 'com.au', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'gov.uk', 'org.au', 'org.uk') AS two FROM lab),
h AS (SELECT host, n, bad, CASE WHEN address THEN '' WHEN two THEN array_to_string(x[-2:], '.') ELSE x[-1] END AS suffix,
  CASE WHEN address THEN name WHEN two THEN array_to_string(x[-3:], '.') ELSE array_to_string(x[-2:], '.') END AS domain FROM x),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
s0 AS (SELECT *, (SELECT sum(bad) / sum(n) FROM s) AS prior FROM s),
s1 AS (SELECT *, (SELECT 1 / least(0.999, greatest(0.001, sum(n * (bad / n - prior) ^ 2 - prior * (1 - prior)) FILTER (n > 0) / sum((n - 1) * prior * (1 - prior)) FILTER (n > 0))) - 1 FROM s0) AS k FROM s0),
s2 AS (SELECT suffix, (bad + k * prior) / (n + k) AS mean FROM s1),
d0 AS (SELECT d.*, s2.mean AS prior FROM d JOIN s2 USING (suffix)),
d1 AS (SELECT *, (SELECT 1 / least(0.999, greatest(0.001, sum(n * (bad / n - prior) ^ 2 - prior * (1 - prior)) FILTER (n > 0) / sum((n - 1) * prior * (1 - prior)) FILTER (n > 0))) - 1 FROM d0) AS k FROM d0),
d2 AS (SELECT domain, suffix, (bad + k * prior) / (n + k) AS mean FROM d1),
h0 AS (SELECT h.*, d2.mean AS prior FROM h JOIN d2 USING (domain, suffix)),
h1 AS (SELECT *, (SELECT 1 / least(0.999, greatest(0.001, sum(n * (bad / n - prior) ^ 2 - prior * (1 - prior)) FILTER (n > 0) / sum((n - 1) * prior * (1 - prior)) FILTER (n > 0))) - 1 FROM h0) AS k FROM h0),
h2 AS (SELECT *, k * prior + bad AS a, k * (1 - prior) + n - bad AS b FROM h1),
h3 AS (SELECT host, (bad + k * prior) / (n + k) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 AS bad_host FROM h2),
r(rule, says) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
f AS (SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says FROM p JOIN r
  ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.says, CASE WHEN bad_host THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN h3 USING (host) LEFT JOIN f ON p.page_id = f.page_id
""")
def op8_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    judged = host_reputation.filter_urls(table(spark, sf, "pages"), outcomes, RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# --- 9: language model ----------------------------------------------------------------------------------------------


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf, "documents"))


# --- 10: near duplicates --------------------------------------------------------------------------------------------


@query("op10_near_duplicates", """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), g AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, reach.low FROM reach JOIN e ON reach.doc_id = e.a),
c AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""")
def op10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf, "documents"))


# --- 11: periodic runs ----------------------------------------------------------------------------------------------


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; the words from the (g % n)-th on of every document whose id has a crc32 h with h % 10 = 0 go round in a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    g = F.floor(h / 10)
    a = F.pmod("g", "n")
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("w")).withColumn("n", F.size("w").cast("long"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    rest = F.col("n") - F.col("a")
    round_ = F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), F.ceil(rest / F.col("p")).cast("int"))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), F.slice(F.flatten(round_), F.lit(1), rest.cast("int")))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


#: crc32 of a decimal number, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, c: list_reduce([xor(x, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))))"""


@query("op11_periodic_runs", rf"""
WITH d0 AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {CRC32_SQL.format("doc_id::VARCHAR")} AS h FROM documents
), d1 AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM d0), d2 AS (SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN g % n END AS a FROM d1),
d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM d2),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) END AS w FROM d3),
g AS (SELECT r, i, list_slice(w, i + 1, i + 16) AS x FROM (SELECT r, w, unnest(range(0, n - 15)) AS i FROM d WHERE n >= 16)),
k AS (SELECT *, count(*) OVER (PARTITION BY r, x) AS c FROM g),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.r = y.r AND x.x = y.x AND x.i < y.i WHERE x.c > 1 AND y.c > 1),
f AS (SELECT r, q, min(i) AS s, max(i) - min(i) + 16 + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM e) GROUP BY r, q, part),
u AS (SELECT * FROM f WHERE l >= 24 AND l >= 3 * q),
v AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.r = u.r AND z.q < u.q AND z.s <= u.s AND z.s + z.l >= u.s + u.l)),
m AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM v GROUP BY r),
t AS (SELECT * FROM v b WHERE NOT EXISTS (SELECT 1 FROM v z WHERE z.r = b.r AND (z.l * b.q > b.l * z.q OR (z.l * b.q = b.l * z.q AND (z.s < b.s OR (z.s = b.s AND z.q < b.q)))))),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM v),
o AS (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM d),
kept AS (SELECT o.r, string_agg(x, ' ' ORDER BY o.i) FILTER (gone.r IS NULL) AS rest FROM o LEFT JOIN gone ON o.r = gone.r AND o.i = gone.i GROUP BY o.r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, t.s::BIGINT AS "start", t.l::BIGINT AS length, t.q::BIGINT AS period, (1000 * t.l // t.q)::BIGINT AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (r) LEFT JOIN t USING (r) LEFT JOIN kept USING (r)
""")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_runs(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.get("runs", F.col("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# --- 12: token alignment --------------------------------------------------------------------------------------------


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = token_alignment.align_tokens(table(spark, sf, "documents"))
    said = F.when(F.col("n_groups") > 0, F.sha2("grouped", 256)).otherwise(F.lit(""))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", said.alias("groups_sha256"), "n_overlaps")


# --- 13: vectors ----------------------------------------------------------------------------------------------------


@query("op13_vector_join", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.9 ELSE FALSE END),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a),
reach(r, low) AS (SELECT r, r FROM v UNION SELECT l.b, reach.low FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT reach.r, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.low GROUP BY reach.r)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, low AS component_id, vec_id IS NOT DISTINCT FROM low AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)
""")
def op13_vector_join(spark: SparkSession, sf: str) -> DataFrame:
    return vector_join.near_vectors(table(spark, sf, "embeddings"))
