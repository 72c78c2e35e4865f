"""Formula columns: spellings, components, patterns, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.catalog.registry import big, joined, query, sql_joined
from pairwright.catalog.views import FORMULAS_SQL, _sql_replace, _sql_text, sql_list, v_formulas
from pairwright.functions import formula as fx
from pairwright.functions import rules
from pairwright.functions.profile import formula_profile


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def ascii_sql(x: str) -> str:
    return strip_sql(_sql_replace(x, vocab.ASCII_FORMS))


def present(items: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {cond} THEN {_sql_text(v)} END" for v, cond in items)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def words_sql(values: list[str]) -> str:
    return "(" + ", ".join(_sql_text(v) for v in values) + ")"


ASCII = f"{FORMULAS_SQL}, a AS (SELECT *, {ascii_sql('formula')} AS f FROM v_formulas)"
AGENTS = (
    "list_sort(list_distinct(flatten(list_transform(regexp_extract_all(f, '<<([^>]+)>>', 1), "
    f"lambda m: list_transform(string_split(m, ','), lambda x: {strip_sql('x')})))))"
)
LOOSE_OPS = present([(o, rf"regexp_matches(f, '\b{o}\b|{o}\s*\(|{o}\s+')") for o in "GFXU"] + [("->", "contains(f, '->')")])
ATOM_BODY = (
    r"regexp_replace(regexp_replace(regexp_replace(f, '<<[^>]+>>', '', 'g'), '\b(G|F|X|U)\b', ' ', 'g'), "
    r"'[!&|()>\-<]', ' ', 'g')"
)
ATOMS = (
    rf"list_sort(list_distinct(list_filter(regexp_extract_all({ATOM_BODY}, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'), "
    f"lambda x: lower(x) NOT IN {words_sql(vocab.NOT_ATOMS)})))"
)


@query("p01_to_ascii", f"WITH {ASCII} SELECT event_id, f AS ascii FROM a")
def p01(spark, sf):
    return v_formulas(spark, sf).select("event_id", fx.to_ascii(F.col("formula")).alias("ascii"))


@query(
    "p02_to_printed",
    f"WITH {ASCII} SELECT event_id, {strip_sql(_sql_replace('f', vocab.PRINTED_FORMS))} AS printed FROM a",
)
def p02(spark, sf):
    return v_formulas(spark, sf).select("event_id", fx.to_printed(fx.to_ascii(F.col("formula"))).alias("printed"))


@query("p03_agents", f"WITH {ASCII} SELECT event_id, {sql_joined(AGENTS)} AS agents FROM a")
def p03(spark, sf):
    return v_formulas(spark, sf).select("event_id", joined(fx.agents(F.col("formula"))).alias("agents"))


@query(
    "p03b_first_coalition",
    f"""WITH {ASCII} SELECT event_id, {sql_joined(
        "list_transform(string_split(regexp_extract(f, '<<([^>]+)>>', 1), ','), lambda x: " + strip_sql("x") + ")"
    )} AS agents FROM a""",
)
def p03b(spark, sf):
    return v_formulas(spark, sf).select(
        "event_id", joined(fx.first_coalition(fx.to_ascii(F.col("formula")))).alias("agents")
    )


@query("p04_operators", f"WITH {ASCII} SELECT event_id, {sql_joined(LOOSE_OPS)} AS operators FROM a")
def p04(spark, sf):
    return v_formulas(spark, sf).select("event_id", joined(fx.temporal_operators(F.col("formula"))).alias("operators"))


SUBSTRING_OPS = present(
    [(o, f"contains(formula, '{o}')") for o in "GFXUWR"] + [(m, f"contains(formula, '{m}')") for m in ["&", "|", "->", "!"]]
)
BOUNDARY_OPS = present(
    [(o, rf"regexp_matches(formula, '\b{o}\b|\b{o}\(')") for o in "GFXUWR"]
    + [
        (a, f"contains(formula, '{a}') OR contains(formula, '{b}')")
        for a, b in [("&", "∧"), ("|", "∨"), ("->", "→"), ("!", "¬")]
    ]
)


@query(
    "p04b_operator_modes",
    f"""WITH {FORMULAS_SQL} SELECT event_id, {sql_joined(SUBSTRING_OPS, ' ')} AS by_substring,
    {sql_joined(BOUNDARY_OPS, ' ')} AS by_boundary FROM v_formulas""",
)
def p04b(spark, sf):
    f = F.col("formula")
    return v_formulas(spark, sf).select(
        "event_id",
        joined(fx.operators(f, "substring"), " ").alias("by_substring"),
        joined(fx.operators(f, "boundary"), " ").alias("by_boundary"),
    )


@query("p05_atoms", f"WITH {ASCII} SELECT event_id, {sql_joined(ATOMS)} AS atoms FROM a")
def p05(spark, sf):
    return v_formulas(spark, sf).select("event_id", joined(fx.atoms(F.col("formula"))).alias("atoms"))


def _idents(x: str, reserved: list[str]) -> str:
    return rf"list_filter(regexp_extract_all({x}, '\b[a-z][a-z0-9_]*\b'), lambda x: x NOT IN {words_sql(reserved)})"


@query(
    "p05b_identifiers",
    f"""WITH {FORMULAS_SQL} SELECT event_id, {sql_joined(_idents('formula', vocab.NOT_IDENTIFIERS))} AS in_order,
    {sql_joined('list_sort(list_distinct(' + _idents('lower(formula)', vocab.NOT_IDENTIFIERS_LOWERED) + '))')} AS lowered
    FROM v_formulas""",
)
def p05b(spark, sf):
    f = F.col("formula")
    return v_formulas(spark, sf).select(
        "event_id", joined(fx.identifiers(f)).alias("in_order"), joined(fx.identifiers(f, True)).alias("lowered")
    )


SCORE = f"""len({LOOSE_OPS}) + len({ATOMS})
  + CASE WHEN contains(f, '->') AND contains(f, 'F') THEN 2 ELSE 0 END
  + CASE WHEN contains(f, 'G') AND contains(f, 'F') THEN 1 ELSE 0 END"""


@query(
    "p08_complexity",
    f"""WITH {ASCII} SELECT event_id, CAST({SCORE} AS BIGINT) AS score,
    CAST(len({LOOSE_OPS}) + len({AGENTS}) AS BIGINT) AS ops_and_agents,
    CAST(len(regexp_extract_all(formula, '\\S+')) AS BIGINT) AS words FROM a""",
)
def p08(spark, sf):
    f = F.col("formula")
    ops, a = fx.temporal_operators(f), fx.to_ascii(f)
    return v_formulas(spark, sf).select(
        "event_id",
        big(fx.complexity(ops, fx.atoms(f), a)).alias("score"),
        big(F.size(ops) + F.size(fx.agents(f))).alias("ops_and_agents"),
        big(F.regexp_count(f, F.lit(r"\S+"))).alias("words"),
    )


@query(
    "p09_complexity_bucket",
    f"""WITH {ASCII}, s AS (SELECT {SCORE} AS score FROM a)
    SELECT CASE WHEN score <= 3 THEN 'low' WHEN score <= 6 THEN 'medium' ELSE 'high' END AS bucket, count(*) AS n
    FROM s GROUP BY 1""",
)
def p09(spark, sf):
    f = F.col("formula")
    score = fx.complexity(fx.temporal_operators(f), fx.atoms(f), fx.to_ascii(f))
    return v_formulas(spark, sf).groupBy(fx.complexity_bucket(score).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def pattern_sql(f: str) -> str:
    t = f"replace({f}, ' ', '')"
    return f"""CASE WHEN contains({t}, 'G(F') THEN 'recurrence' WHEN contains({t}, 'F(G') THEN 'persistence'
      WHEN contains({t}, 'G(') AND contains({t}, '->F(') THEN 'response'
      WHEN contains({t}, ')U(') OR contains({f}, ' U ') OR contains({f}, ')U ') THEN 'until'
      WHEN contains({t}, 'G(!') OR contains({t}, 'G(¬') THEN 'safety'
      WHEN contains({t}, 'G(') THEN 'invariant' WHEN contains({t}, 'F(') THEN 'liveness' ELSE 'unknown' END"""


@query("p10_pattern", f"WITH {ASCII} SELECT event_id, {pattern_sql('f')} AS pattern FROM a")
def p10(spark, sf):
    return v_formulas(spark, sf).select("event_id", fx.pattern(fx.to_ascii(F.col("formula"))).alias("pattern"))


FLAT = lambda x: f"lower(regexp_replace({ascii_sql(x)}, '\\s+', '', 'g'))"
SHAPED = f"""{FORMULAS_SQL}, s AS (SELECT *, '⟨⟨user_' || user_id || '⟩⟩ G ( ' || upper(event_type) || ' )' AS other,
  '<<user_' || user_id || '>> G (' || event_type || ')' AS again FROM v_formulas)"""


@query(
    "p21_same_formula",
    f"""WITH {SHAPED} SELECT event_id, {FLAT('other')} = {FLAT('again')} AS same_text,
    {FLAT('formula')} = {FLAT('other')} AS same_shape FROM s""",
)
def p21(spark, sf):
    user = F.col("user_id").cast("string")
    other = F.concat(F.lit("⟨⟨user_"), user, F.lit("⟩⟩ G ( "), F.upper("event_type"), F.lit(" )"))
    again = F.concat(F.lit("<<user_"), user, F.lit(">> G ("), F.col("event_type"), F.lit(")"))
    return v_formulas(spark, sf).select(
        "event_id",
        fx.same_formula(other, again).alias("same_text"),
        fx.same_formula(F.col("formula"), other).alias("same_shape"),
    )


def n_of(x: str, piece: str) -> str:
    return f"((length({x}) - length(replace({x}, '{piece}', ''))) // {len(piece)})"


STRUCTURE = f"""{FORMULAS_SQL}, c AS (
  SELECT event_id, f, regexp_matches(f, '^(<<|⟨⟨)\\s*([^>⟩]*)\\s*(>>|⟩⟩)') AS leads,
    {strip_sql("regexp_extract(f, '^(<<|⟨⟨)\\s*([^>⟩]*)\\s*(>>|⟩⟩)', 2)")} AS members,
    {n_of('f', '(')} AS po, {n_of('f', ')')} AS pc, {n_of('f', '<<')} AS al, {n_of('f', '>>')} AS ar,
    {n_of('f', '⟨⟨')} AS ul, {n_of('f', '⟩⟩')} AS ur,
    regexp_extract_all(f, '\\b([GFXU])\\b', 1) AS letters
  FROM (SELECT event_id, {strip_sql('formula')} AS f FROM v_formulas)),
e AS (SELECT *, list_filter([
    CASE WHEN NOT leads AND NOT contains(f, '<<') AND NOT contains(f, '⟨⟨') THEN {_sql_text(vocab.MSG_NEEDS_COALITION)} END,
    CASE WHEN po <> pc THEN 'Unbalanced parentheses: ' || po || ' open, ' || pc || ' close' END,
    CASE WHEN al <> ar THEN 'Unbalanced ASCII coalition brackets: ' || al || ' << vs ' || ar || ' >>' END,
    CASE WHEN ul <> ur THEN {_sql_text(vocab.MSG_UNICODE_BRACKETS)} END,
    CASE WHEN regexp_matches(f, '>>\\s*$|⟩⟩\\s*$') THEN {_sql_text(vocab.MSG_ENDS_WITH_COALITION)} END],
    lambda x: x IS NOT NULL) AS errors,
  list_filter([
    CASE WHEN leads AND members = '' THEN {_sql_text(vocab.MSG_EMPTY_COALITION)} END,
    CASE WHEN len(letters) = 0 THEN {_sql_text(vocab.MSG_MAYBE_INCOMPLETE)} END,
    CASE WHEN regexp_matches(f, '[GFX]\\s*[GFX]') THEN {_sql_text(vocab.MSG_CONSECUTIVE)} END],
    lambda x: x IS NOT NULL) AS warnings,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(f, '<<[^>]*>>', '', 'g'), '⟨⟨[^⟩]*⟩⟩', '', 'g'),
    '\\b(G|F|X|U|and|or|not|implies|true|false)\\b', '', 'g'), '[()∧∨¬→&|!>\\-]', ' ', 'g') AS body FROM c)"""


@query(
    "f06_structure_rules",
    f"""WITH {STRUCTURE} SELECT event_id, len(errors) = 0 AS valid, {sql_joined('errors')} AS errors,
    {sql_joined('warnings')} AS warnings,
    CASE WHEN len(errors) = 0 THEN array_to_string(list_sort(list_distinct(letters)), '') END AS temporal_ops,
    CASE WHEN len(errors) = 0 THEN {sql_joined("list_sort(list_distinct(list_filter(regexp_extract_all(body, '\\S+'), lambda x: regexp_matches(x, '^[a-zA-Z_]'))))")} END AS atoms,
    CASE WHEN len(errors) = 0 AND leads THEN {sql_joined("list_filter(list_transform(string_split(members, ','), lambda x: " + strip_sql('x') + "), lambda x: x <> '')")} END AS agents,
    CASE WHEN len(errors) = 0 THEN CAST(greatest(po, al + ul, len(letters)) AS BIGINT) END AS depth FROM e""",
)
def f06(spark, sf):
    s = F.col("s")
    return (
        v_formulas(spark, sf)
        .select("event_id", rules.check_structure(F.col("formula")).alias("s"))
        .select(
            "event_id", s["valid"].alias("valid"), joined(s["errors"]).alias("errors"), joined(s["warnings"]).alias("warnings"),
            F.array_join(s["temporal_ops"], "").alias("temporal_ops"), F.array_join(s["atoms"], "|").alias("atoms"),
            F.array_join(s["agents"], "|").alias("agents"), big(s["depth"]).alias("depth"),
        )
    )


def errors_sql(f: str, temporal: str, square: bool) -> str:
    has = (
        "(" + " OR ".join(f"contains({f}, '{o}')" for o in "FGXUWR") + ")"
        if temporal == "substring"
        else f"regexp_matches({f}, '\\b[FGXUWR]\\b|\\b[FGXUWR]\\(')"
    )
    bare = f"replace(replace({f}, '->', ''), '<-', '')"
    checks = [
        (vocab.MSG_NO_COALITION, f"NOT regexp_matches({f}, '<<[^>]+>>')"),
        (vocab.MSG_NO_TEMPORAL, f"NOT {has}"),
        (vocab.MSG_PARENS, f"{n_of(f, '(')} <> {n_of(f, ')')}"),
    ]
    if square:
        checks.append((vocab.MSG_SQUARE, f"{n_of(f, '[')} <> {n_of(f, ']')}"))
    checks.append((vocab.MSG_ANGLES, f"{n_of(bare, '<')} <> {n_of(bare, '>')}"))
    return f"CASE WHEN {f} = '' THEN [{_sql_text(vocab.MSG_EMPTY)}] ELSE {present(checks)} END"


@query("f07_rules_substring", f"WITH {ASCII} SELECT event_id, {sql_joined(errors_sql('f', 'substring', True))} AS errors FROM a")
def f07(spark, sf):
    errors = rules.formula_errors(fx.to_ascii(F.col("formula")), "substring", True)
    return v_formulas(spark, sf).select("event_id", joined(errors).alias("errors"))


@query(
    "f08_rules_boundary",
    f"""WITH {FORMULAS_SQL}, a AS (SELECT event_id, {strip_sql('formula')} AS f FROM v_formulas)
    SELECT event_id, {sql_joined(errors_sql('f', 'boundary', False))} AS errors FROM a""",
)
def f08(spark, sf):
    errors = rules.formula_errors(F.col("formula"), "boundary", False)
    return v_formulas(spark, sf).select("event_id", joined(errors).alias("errors"))


# What each shape has, in order of the shapes: nesting depth, temporal letters in order, other reading of the printed form.
DEPTHS = [1, 1, 1, 1, 2, 2, 2, 1, 2, 3, 2, 2, 2, 2, 2, 2, 1, 1, 2, 1]
LETTERS = ["G", "G", "F", "X", "U", "GF", "GX", "G", "F", "FG", "FG", "GF", "U", "GG", "GF", "U", "F", "F", "FF", "G"]
# A coalition before a bracket adds a level; without the coalition it is gone.
BRACKETS = [i + 1 for i, (_, _, t) in enumerate(vocab.FORMULA_SHAPES) if t.startswith("⟨⟨{coalition}⟩⟩ (")]
LOOSE_SIGNS = "→¬∧∨"
PRINTED_SHAPES = [t.replace("(F {p} → G {p})", "F ({p} → G {p})") for _, _, t in vocab.FORMULA_SHAPES]

PROFILE_SQL = f"""{FORMULAS_SQL},
pr0 AS (SELECT event_id, user_id, k, event_type, event_id % 20 + 1 AS no, ({sql_list(PRINTED_SHAPES)})[event_id % 20 + 1] AS shape,
  list_sort(CASE WHEN event_id % 3 = 0 THEN ['user_' || user_id, 'unit' || (k % 7)] ELSE ['user_' || user_id] END) AS members, nl, template_id FROM v_formulas),
pr1 AS (SELECT *, NOT (k IN (13, 19, 23, 29) OR k = 11 AND contains(shape, ')') OR k % 4 = 2 AND regexp_matches(shape, '[{LOOSE_SIGNS}]')) AS valid, k <> 17 AS led FROM pr0),
pr AS (SELECT event_id, user_id, nl, template_id, no, shape, led, valid,
  CASE WHEN valid THEN ({DEPTHS})[no] - CASE WHEN NOT led AND no IN {tuple(BRACKETS)} THEN 1 ELSE 0 END END AS depth,
  CASE WHEN valid THEN CASE WHEN led THEN members ELSE [] END END AS agents,
  CASE WHEN valid THEN list_sort(list_filter([CASE WHEN contains(shape, '{{p}}') THEN event_type END, CASE WHEN contains(shape, '{{q}}') THEN 'state_' || (k % 10) END,
    CASE WHEN contains(shape, '{{r}}') THEN 'goal_' || (user_id % 10) END], lambda x: x IS NOT NULL)) END AS atoms,
  CASE WHEN valid THEN ({sql_list(LETTERS)})[no] END AS letters,
  CASE WHEN valid THEN replace(replace(replace(CASE WHEN led THEN replace(shape, '{{coalition}}', array_to_string(members, ',')) ELSE replace(shape, '⟨⟨{{coalition}}⟩⟩ ', '') END,
    '{{p}}', event_type), '{{q}}', 'state_' || (k % 10)), '{{r}}', 'goal_' || (user_id % 10)) END AS normalised FROM pr1)"""


@query(
    "f14_formula_profile",
    f"""WITH {PROFILE_SQL} SELECT event_id, valid, CASE WHEN valid THEN '' ELSE 'Parse error' END AS errors, depth::INTEGER AS depth, {sql_joined('agents')} AS agents,
      {sql_joined('atoms')} AS atoms, coalesce(letters, '') AS operators, CASE WHEN valid THEN led::INTEGER END AS coalition_count,
      CASE WHEN valid THEN len(agents)::INTEGER END AS max_coalition_size, normalised FROM pr""",
)
def f14(spark, sf):
    p = F.col("p")
    return (
        v_formulas(spark, sf)
        .select("event_id", formula_profile(F.col("formula")).alias("p"))
        .select(
            "event_id", p["valid"].alias("valid"), F.regexp_replace(joined(p["errors"]), "Parse error: .*", "Parse error").alias("errors"), p["depth"].alias("depth"),
            joined(p["agents"]).alias("agents"), joined(p["atoms"]).alias("atoms"), joined(p["operators"], "").alias("operators"),
            p["coalition_count"].alias("coalition_count"), p["max_coalition_size"].alias("max_coalition_size"),
            p["normalised"].alias("normalised"),
        )
    )
