"""Scans of stored datasets into one row type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import schemas
from pairwright.functions.text import strip, word_count
from pairwright.operators.ranking import dense_index
from pairwright.sources.json_lists import read_json_lists

BROKEN = "broken_line"


def _with_old_spellings(row: T.StructType) -> T.StructType:
    have = set(row.names)
    return T.StructType(row.fields + [f for f in schemas.OLD_SPELLINGS.fields if f.name not in have])


def unify(df: DataFrame, row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Old field names to current ones, known fields only, absent ones null (domain: generic)."""
    have = set(df.columns)
    other = {
        "id": ["id", "sample_id"],
        "nl_statement": ["nl_statement", "nl_text", "nl"],
        "atl_formula": ["atl_formula", "atl"],
        "source_file": ["source_file", "source"],
    }

    def pick(f: T.StructField) -> Column:
        names = [n for n in other.get(f.name, [f.name]) if n in have]
        out = F.coalesce(*[F.col(n) for n in names]) if names else F.lit(None)
        if f.name == "domain":
            out = F.coalesce(out, F.lit("generic"))
        return out.cast(f.dataType).alias(f.name)

    return df.select(*[pick(f) for f in row.fields])


def read_jsonl(spark: SparkSession, path, row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """One object per line; blank lines give no row. A broken line is an error."""
    return unify(spark.read.schema(_with_old_spellings(row)).option("mode", "FAILFAST").json(path), row)


def parsed_lines(spark: SparkSession, path, row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Non-blank lines: file, line, parsed, broken. Rows, rejects and counts all come from this one parse."""
    wide = _with_old_spellings(row).add(BROKEN, T.StringType())
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    lines = lines.filter(strip(F.col("line")) != "")
    parsed = F.from_json("line", wide, {"columnNameOfCorruptRecord": BROKEN, "mode": "PERMISSIVE"})
    return lines.withColumn("parsed", parsed).withColumn("broken", F.col(f"parsed.{BROKEN}").isNotNull())


def read_jsonl_lenient(spark: SparkSession, path, row: T.StructType = schemas.SAMPLE) -> tuple[DataFrame, DataFrame]:
    """Rows, and the broken lines with their file."""
    lines = parsed_lines(spark, path, row)
    good = lines.filter(~F.col("broken")).select("parsed.*").drop(BROKEN)
    return unify(good, row), lines.filter("broken").select(F.element_at(F.split("file", "/"), -1).alias("file"), "line")


def line_counts(spark: SparkSession, paths: list[str], row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Good and broken lines of each file."""
    parts = [parsed_lines(spark, p, row).select("file", "broken") for p in paths]
    lines = reduce(DataFrame.unionByName, parts)
    return lines.groupBy("file").agg(F.count_if(~F.col("broken")).alias("good"), F.count_if("broken").alias("broken"))


def read_large_json(spark: SparkSession, path: str, row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Documents that are lists of any length, {"samples": [..]} or {"pairs": [..]}, read by as many tasks as they have splits."""
    return unify(read_json_lists(spark, path, _with_old_spellings(row)).select("element.*"), row)


def read_json_document(
    spark: SparkSession, path, row: T.StructType = schemas.SAMPLE, one_per_line: bool = False
) -> DataFrame:
    """A document that is a list, {"samples": [..]} or {"pairs": [..]}; anything else is an error.

    A file is one document, or one per line; only the latter can be split among
    tasks. ``read_large_json`` splits a single list.
    """
    wide = _with_old_spellings(row)
    arr = T.ArrayType(wide)
    outer = T.StructType([*wide.fields, T.StructField("samples", arr), T.StructField("pairs", arr)])
    raw = spark.read.schema(outer).option("multiLine", not one_per_line).json(path)
    empty = reduce(lambda a, b: a & b, [F.col(n).isNull() for n in wide.names])
    own = F.when(empty, F.raise_error(F.lit("Unsupported JSON structure")).cast(arr)).otherwise(
        F.array(F.struct(*wide.names))
    )
    rows = raw.select(F.explode(F.coalesce("samples", "pairs", own)).alias("r")).select("r.*")
    return unify(rows, row)


def read_samples(spark: SparkSession, paths: list[str], row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Concatenation of .jsonl and .json sources; other extensions are an error, as is a missing file.

    Broken lines are in ``read_rejects``, their number per file in ``line_counts``.
    """
    if not paths:
        raise ValueError("no sources")
    parts = []
    for p in paths:
        name = p.rstrip("/")
        if name.endswith(".jsonl"):
            parts.append(read_jsonl_lenient(spark, p, row)[0])
        elif name.endswith(".json"):
            parts.append(read_json_document(spark, p, row))
        else:
            raise ValueError(f"Unsupported file format: {p}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_rejects(spark: SparkSession, paths: list[str], row: T.StructType = schemas.SAMPLE) -> DataFrame:
    """Broken lines of the line-based sources: file, line."""
    parts = [read_jsonl_lenient(spark, p, row)[1] for p in paths if p.rstrip("/").endswith(".jsonl")]
    if not parts:
        return spark.createDataFrame([], "file string, line string")
    return reduce(DataFrame.unionByName, parts)


def read_statements(spark: SparkSession, path) -> DataFrame:
    """One statement per line, stripped, without empty lines."""
    line = strip(F.col("value"))
    return spark.read.text(path).select(line.alias("nl_statement")).filter(F.col("nl_statement") != "")


def split_statements(df: DataFrame, text: str) -> DataFrame:
    """The same from a text column; keeps the other columns and the line position."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return lines.withColumn("nl_statement", strip(F.col("line"))).drop("line").filter(F.col("nl_statement") != "")


def assign_ids(df: DataFrame, order: str, key: str = "sample_id") -> DataFrame:
    """Missing ids become loaded_<position>, counting all rows from 0 in input order."""
    numbered = dense_index(df, order, "_i")
    return numbered.withColumn(key, F.coalesce(key, F.format_string("loaded_%04d", F.col("_i")))).drop("_i")


def read_verification_log(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(schemas.METRIC).json(path)


def flatten_results(results: DataFrame) -> DataFrame:
    """Nested verification results to log rows.

    The domain is unknown here; without a semantic check its outcome is null
    and the confidence 0; complexity is the word count of the formula.
    """
    return results.select(
        "sample_id",
        F.lit("unknown").alias("domain"),
        F.col("syntax_check.valid").alias("syntax_valid"),
        F.col("semantic_check.matches").alias("semantic_verified"),
        F.coalesce(F.col("semantic_check.confidence"), F.lit(0.0)).alias("confidence"),
        "cross_model_agreement",
        word_count(F.col("original_atl")).alias("complexity"),
        F.col("verification_time_ms").alias("latency_ms"),
        F.lit(0).cast("bigint").alias("prompt_tokens"),
        F.lit(0).cast("bigint").alias("completion_tokens"),
    )


def translations_long(comparison: DataFrame) -> DataFrame:
    """One row per statement and model."""
    rest = [c for c in comparison.columns if c != "translations"]
    return comparison.select(*rest, F.explode("translations").alias("model", "t")).select(*rest, "model", "t.*")


def reviews_long(reviews: DataFrame) -> DataFrame:
    """One row per statement and model with the reviewer's judgement (null: not reviewed)."""
    judged = F.try_element_at(F.col("review"), F.concat(F.col("model"), F.lit("_correct")))
    return translations_long(reviews).withColumn("correct", judged.cast("boolean"))
