"""Pairs from templates.

A draw is a row with a number. Everything chosen for it (shape, domain,
agents, atoms, wording) follows from the seeded hash of this number, so any
partitioning gives the same pairs, and a failed task can be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright import vocab
from pairwright.functions import formula as fx
from pairwright.functions.identity import seeded, seeded_choice
from pairwright.functions.rules import check_structure
from pairwright.operators.enrich import sample_columns
from pairwright.operators.keep import keep_where
from pairwright.operators.ranking import measured


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _named(named: list[str] | None) -> list[str]:
    return list(vocab.AGENT_PHRASES) if named is None else named


def coalition_count(max_agents: int = 3, named: list[str] | None = None) -> int:
    """Size of the coalition space: single numbered agents, pairs of them, all of them, and single named ones."""
    return max_agents + max_agents * (max_agents - 1) // 2 + (max_agents > 1) + len(_named(named))


def coalition_at(index: Column, max_agents: int = 3, named: list[str] | None = None) -> Column:
    """Coalition number index (cyclic) of the space, in the order given above; pairs in order of their first member.

    The members follow from the index, so the number of agents has no limit.
    """
    n, names = max_agents, _named(named)
    pairs = n * (n - 1) // 2
    i = F.pmod(index, F.lit(coalition_count(max_agents, named))).cast("long")
    p = i - n  # number of the pair; (first, second) count from 0
    first = F.floor((F.lit(2 * n - 1) - F.sqrt(F.greatest(F.lit((2 * n - 1) ** 2) - 8 * p, F.lit(0)))) / 2)
    second = p - F.floor(first * (F.lit(2 * n - 1) - first) / 2) + first + 1
    out = F.when(i < n, F.array((i + 1).cast("string")))
    if n > 1:
        out = out.when(i < n + pairs, F.array((first + 1).cast("string"), (second + 1).cast("string")))
        out = out.when(i == n + pairs, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda a: a.cast("string")))
    if names:
        out = out.otherwise(F.array(F.element_at(_strings(names), (F.greatest(i - (n + pairs + (n > 1)), F.lit(0)) + 1).cast("int"))))
    return out


def sample_coalition(draw: Column, seed: int, max_agents: int = 3, named: list[str] | None = None) -> Column:
    return coalition_at(seeded_choice(draw, seed, coalition_count(max_agents, named)), max_agents, named)


def pick_members(agents: Column, draw: Column, seed: int) -> Column:
    """One or two different agents of a list."""
    n = F.size(agents)
    first = seeded_choice(draw, seed, F.greatest(n, F.lit(1)))
    step = seeded_choice(draw, seed + 1, F.greatest(n - 1, F.lit(1))) + 1
    two = (n > 1) & (seeded_choice(draw, seed + 2, 2) == 1)
    a = F.get(agents, first)
    b = F.get(agents, F.pmod(first + step, F.greatest(n, F.lit(1))))
    return F.when(n == 0, F.array().cast("array<string>")).when(two, F.array(a, b)).otherwise(F.array(a))


def pick_atoms(atoms: Column, draw: Column, seed: int, k: Column | int) -> Column:
    """k entries of an atom -> phrase map in seeded order, as structs (atom, phrase)."""
    k = F.lit(k) if isinstance(k, int) else k
    keyed = F.transform(
        F.map_entries(atoms),
        lambda e: F.struct(
            seeded(F.concat(draw.cast("string"), F.lit("/"), e["key"]), seed).alias("o"),
            e["key"].alias("atom"),
            e["value"].alias("phrase"),
        ),
    )
    chosen = F.slice(F.sort_array(keyed), F.lit(1), k)
    return F.transform(chosen, lambda s: F.struct(s["atom"].alias("atom"), s["phrase"].alias("phrase")))


def default_atoms() -> Column:
    return F.create_map(*[F.lit(x) for kv in vocab.ATOM_PHRASES.items() for x in kv])


def indexed_domains(domains: DataFrame) -> DataFrame:
    """Domain dimension with a number per domain in name order. One row per domain."""
    numbered = W.partitionBy(F.lit(0)).orderBy("domain")
    return measured(domains.withColumn("domain_no", (F.row_number().over(numbered) - 1).cast("int")))


def frames_for(shape: str, frames: list[str] | None = None) -> list[str]:
    tail = (vocab.SECOND_PHRASE if "{q}" in shape else "") + (vocab.THIRD_PHRASE if "{r}" in shape else "")
    return frames if frames else [f + tail for f in vocab.STATEMENT_FRAMES]


def _numbered_shapes(shapes: DataFrame) -> DataFrame:
    """Template dimension with a number per template, in order of its id. One row per template."""
    s = F.col("shape")
    holes = sum((F.contains(s, F.lit(h)).cast("int") for h in ("{p}", "{q}", "{r}")), F.lit(0))
    tail = F.concat(F.when(F.contains(s, F.lit("{q}")), vocab.SECOND_PHRASE).otherwise(""), F.when(F.contains(s, F.lit("{r}")), vocab.THIRD_PHRASE).otherwise(""))
    usual = F.transform(_strings(vocab.STATEMENT_FRAMES), lambda f: F.concat(f, tail))
    own = F.when(F.size("frames") > 0, F.col("frames")).otherwise(usual)
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("template_id")) - 1
    packed = F.struct("template_id", "category", "shape", own.alias("frames"), holes.alias("holes"))
    return measured(shapes.select(number.cast("int").alias("_shape_no"), packed.alias("_t")))


def base_pairs(
    draws: DataFrame,
    draw: str,
    seed: int,
    shapes: list[tuple[str, str, str]] | DataFrame | None = None,
    frames: dict[str, list[str]] | None = None,
    domains: DataFrame | None = None,
    max_agents: int = 3,
) -> DataFrame:
    """One pair per draw: draw, vocabulary domain, template id, category, statement and formula.

    Draw numbers walk through the shapes in turn. ``shapes`` is a list, or a
    table of (template_id, category, shape, frames) that is joined by number;
    null frames mean the usual ones. Rows whose formula breaks a structural rule
    are left out.
    """
    d = F.col(draw)
    if isinstance(shapes, DataFrame):
        numbered = _numbered_shapes(shapes)
        no = F.pmod(d, F.lit(max(1, numbered.count()))).cast("int")
        rows = draws.withColumn("_no", no).join(numbered, F.col("_no") == F.col("_shape_no")).drop("_no", "_shape_no")
    else:
        shapes = shapes or vocab.FORMULA_SHAPES
        table = F.array(
            *[
                F.struct(
                    F.lit(i).alias("template_id"), F.lit(c).alias("category"), F.lit(s).alias("shape"),
                    _strings(frames_for(s, (frames or {}).get(i))).alias("frames"),
                    F.lit(sum(h in s for h in ("{p}", "{q}", "{r}"))).alias("holes"),
                )
                for i, c, s in shapes
            ]
        )
        rows = draws.withColumn("_t", F.get(table, F.pmod(d, F.lit(len(shapes))).cast("int")))
    if domains is None:
        rows = rows.withColumn("_members", sample_coalition(d, seed, max_agents)).withColumn("_atoms", default_atoms())
        rows = rows.withColumn("vocabulary", F.lit(None).cast("string"))
    else:
        numbered = indexed_domains(domains)
        chosen = seeded_choice(d, seed + 3, max(1, numbered.count()))
        rows = rows.withColumn("domain_no", chosen).join(
            numbered.select("domain_no", F.col("domain").alias("vocabulary"), "agents", "atoms"), "domain_no", "left"
        )
        own = F.size("agents") > 0
        rows = rows.withColumn(
            "_members", F.when(own, pick_members(F.col("agents"), d, seed)).otherwise(sample_coalition(d, seed, max_agents))
        ).withColumn(
            "_atoms",
            F.when(F.size(F.map_keys("atoms")) >= F.col("_t.holes"), F.col("atoms")).otherwise(default_atoms()),
        ).drop("domain_no", "agents", "atoms")
    rows = rows.withColumn("_members", fx.sorted_members(F.col("_members")))
    rows = rows.withColumn("_picked", pick_atoms(F.col("_atoms"), d, seed + 4, F.col("_t.holes")))
    frame = F.get(F.col("_t.frames"), seeded_choice(d, seed + 5, F.size("_t.frames")))
    members = F.col("_members")

    def hole(i: int, part: str) -> Column:
        return F.get(F.col("_picked"), F.lit(i))[part]

    formula = fx.fill(
        F.col("_t.shape"),
        {"coalition": F.array_join(members, ","), "p": hole(0, "atom"), "q": hole(1, "atom"), "r": hole(2, "atom")},
    )
    nl = fx.fill(
        frame,
        {"coalition_nl": fx.members_text(members), "p_nl": hole(0, "phrase"), "q_nl": hole(1, "phrase"), "r_nl": hole(2, "phrase")},
    )
    out = rows.select(
        *draws.columns, "vocabulary", F.col("_t.template_id").alias("template_id"), F.col("_t.category").alias("category"),
        nl.alias("nl"), formula.alias("formula"),
    )
    return keep_where(out, check_structure(F.col("formula"))["valid"])


def generated_samples(pairs: DataFrame, provider: str = "none") -> DataFrame:
    return pairs.select(
        *sample_columns(F.col("nl"), F.col("formula"), F.col("template_id"), F.lit(provider))
    )


def with_paraphrases(pairs: DataFrame, items: str) -> DataFrame:
    """Originals plus one row per paraphrase; a paraphrase keeps its parent's columns, no join needed."""

    nl = F.col("nl")
    rest = [c for c in pairs.columns if c not in ("nl", items)]
    texts = F.posexplode(F.concat(F.array(nl), F.col(items))).alias("_no", "_text")
    parent = F.when(F.col("_no") > 0, nl.cast("string"))
    return pairs.select(*rest, "nl", texts).select(*rest, F.col("_text").alias("nl"), parent.alias("paraphrase_of"))
