"""Text files that hold statements and formulas.

Either a file is one row and its lines are paired inside the row, without a
shuffle (``read_texts``), or a line is a row (``read_lines``) and files of any
length are split among tasks; such tables are paired by ``pair_line_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.functions import formula as fx
from pairwright.functions import identity as ident
from pairwright.functions.text import let, strip
from pairwright.operators.identity import first_seen
from pairwright.operators.keep import explode_computed, keep_where
from pairwright.operators.neighbours import with_next
from pairwright.operators.ranking import with_columns_of
from pairwright.session import cut_lineage

PAIR = "array<struct<pos:int,nl:string,formula:string>>"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the .txt files of a folder."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line) of the .txt files of a folder; ``pos`` counts a file's lines from 0.

    A file's splits are read on their own. Inside a split lines are numbered by
    the order of the scan; the line counts of a file's earlier splits, one row
    each, shift them.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start")]
    raw = spark.read.text(path, pathGlobFilter="*.txt").select(*meta, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    raw = cut_lineage(raw, "lines")
    splits = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = with_columns_of(raw, offsets, ["file", "_start"])
    return placed.select("file", (F.col("_off") + F.col("_id") - F.col("_first")).alias("pos"), "line")


def opens_formula(line: Column) -> Column:
    return F.startswith(line, F.lit("<<")) | F.startswith(line, F.lit("⟨⟨"))


def text_format(text: Column) -> Column:
    """1: quoted line, formula below; 2: quoted line and formula on one line; 3: plain line, formula below."""
    return (
        F.when(F.regexp_like(text, F.lit(r'"[^"]+"\s*\n\s*(<<|⟨⟨)')), 1)
        .when(F.regexp_like(text, F.lit(r'"[^"]+"\s*->\s*[⟨<]')), 2)
        .otherwise(3)
    )


def _line_pairs(text: Column) -> Column:
    def pairs(lines: Column) -> Column:
        return F.transform(
            lines,
            lambda nl, i: F.struct(i.cast("int").alias("pos"), nl.alias("nl"), F.get(lines, i + 1).alias("formula")),
        )

    return let(F.transform(F.split(strip(text), "\n"), strip), pairs)


def _is_statement(line: Column) -> Column:
    skipped = F.regexp_like(line, F.lit("^(#|❌|Interpreting)"))
    return (line != "") & ~skipped & ~opens_formula(line)


def plain_pairs(text: Column, strip_quotes: bool = False) -> Column:
    """Format 3 pairs of a text. Quotes around the statement are kept unless asked otherwise."""
    pairs = F.filter(
        _line_pairs(text), lambda p: _is_statement(p["nl"]) & F.coalesce(opens_formula(p["formula"]), F.lit(False))
    )
    if not strip_quotes:
        return pairs
    return F.transform(
        pairs, lambda p: p.withField("nl", F.regexp_replace(p["nl"], '^["“”]+|["“”]+$', ""))
    )


def quoted_pairs(text: Column) -> Column:
    """Format 1 pairs: a quoted line and the formula line below it."""

    def wanted(p: Column) -> Column:
        quoted = F.startswith(p["nl"], F.lit('"')) & F.endswith(p["nl"], F.lit('"'))
        return quoted & F.coalesce(opens_formula(p["formula"]), F.lit(False))

    found = F.filter(_line_pairs(text), wanted)
    return F.transform(found, lambda p: p.withField("nl", strip(F.regexp_replace(p["nl"], '^"|"$', ""))))


def same_line_pairs(text: Column) -> Column:
    """Format 2 pairs: "statement" -> formula, up to the next quoted line or blank line."""
    pattern = F.lit(r'(?s)"([^"]+)"\s*->\s*(.+?)(?=\n"|\n\n|\z)')
    nl = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), strip)
    formulas = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), strip)
    both = F.transform(
        F.arrays_zip(nl.alias("nl"), formulas.alias("formula")),
        lambda p, i: F.struct(i.cast("int").alias("pos"), p["nl"].alias("nl"), p["formula"].alias("formula")),
    )
    return F.filter(both, lambda p: (p["nl"] != "") & (p["formula"] != ""))


def pairs_of(text: Column, strip_quotes: bool = False) -> Column:
    """Pairs by the detected format."""

    def by_format(t: Column) -> Column:
        kind = text_format(t)
        return (
            F.when(kind == 1, quoted_pairs(t).cast(PAIR))
            .when(kind == 2, same_line_pairs(t).cast(PAIR))
            .otherwise(plain_pairs(t, strip_quotes).cast(PAIR))
        )

    return let(text, by_format)


def parse_texts(files: DataFrame, strip_quotes: bool = False) -> DataFrame:
    """(file, pos, nl, formula) rows of all files."""
    pairs = files.select("file", pairs_of(F.col("text"), strip_quotes).alias("ps"))
    return pairs.select("file", explode_computed("ps").alias("p")).select("file", "p.*")


def to_samples(pairs: DataFrame) -> DataFrame:
    """Parsed pairs as enriched sample rows."""
    nl, f = F.col("nl"), F.col("formula")
    ascii_form = fx.to_ascii(f)
    return pairs.select(
        ident.content_id(nl, ascii_form).alias("id"),
        nl.alias("nl_statement"),
        ascii_form.alias("atl_formula"),
        fx.to_printed(ascii_form).alias("atl_unicode"),
        ident.domain_of(nl, f).alias("domain"),
        F.col("file").alias("source_file"),
        fx.agents(f).alias("agents"),
        fx.temporal_operators(f).alias("operators"),
        fx.atoms(f).alias("atoms"),
        "pos",
    )


def load_texts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store rows (first of each id, files in name order) and (file, added, duplicates)."""
    samples = to_samples(parse_texts(files))
    store = first_seen(samples, "id", F.struct("source_file", "pos"))
    totals = samples.groupBy(F.col("source_file").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    # the counts need ids and files only
    order = F.struct("source_file", "pos")
    firsts = samples.groupBy("id").agg(F.min_by("source_file", order).alias("file"))
    new = firsts.groupBy("file").agg(F.count(F.lit(1)).alias("added"))
    counts = totals.join(new, "file", "left").select(
        "file", F.coalesce("added", F.lit(0)).alias("added"), (F.col("n") - F.coalesce("added", F.lit(0))).alias("duplicates")
    )
    return store.drop("pos"), counts


def load_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Store rows of the .txt files of a folder, and a report with a row per file.

    ``outcome`` is loaded, no_pairs, or undecodable for a file that is not UTF-8,
    which is left out; added and duplicates count the pairs of a loaded file. Files
    of no bytes give no row.
    """
    files = read_texts(spark, folder).withColumn("_ok", F.is_valid_utf8("text"))
    store, counts = load_texts(keep_where(files, F.col("_ok")).drop("_ok"))
    known = files.select("file", "_ok").join(counts, "file", "left")
    outcome = F.when(~F.col("_ok"), "undecodable").when(F.col("added").isNull(), "no_pairs").otherwise("loaded")
    zero = F.lit(0).cast("bigint")
    return store, known.select("file", outcome.alias("outcome"), F.coalesce("added", zero).alias("added"), F.coalesce("duplicates", zero).alias("duplicates"))


def pair_line_table(lines: DataFrame, keys: list[str], pos: str, line: str, chunk: int = 100_000) -> DataFrame:
    """Format 3 on a table with one line per row, for files of any length."""
    near = with_next(lines, keys, pos, F.floor(F.col(pos) / chunk), [line])
    nl, below = strip(F.col(line)), strip(F.col(f"next_{line}"))
    wanted = _is_statement(nl) & F.coalesce(opens_formula(below), F.lit(False))
    return near.filter(wanted).select(*keys, pos, nl.alias("nl"), below.alias("formula"))
