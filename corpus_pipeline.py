"""The corpus pipeline: documents through five operators of ``pairwright.llm``, table by table.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that its
predecessor kept; stages are written as Parquet and read again between them. All
but the last return the columns of ``documents``; a text that was cut gets its new
length in ``n_chars``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm import decontamination, mixing, near_duplicates, quality, substring_dedup
from pairwright.llm.frames import give_back, kept_table, text_key
from pairwright.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the rules or the trained model reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = quality.judge(docs, labels).where("kept").select(*COLUMNS)
    give_back()  # the driver has trained
    return kept


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id (null ids last, then by text).

    Of rows that repeat its id and text one is kept. Texts without words are in no
    group and stay.
    """
    rows = kept_table(near_duplicates.near_duplicates(docs, detail=True).where("component is not null").select("doc_id", "text_key", "component"), "groups")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_first"))
    texts = rows.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("copies"))
    texts = texts.join(first.withColumnRenamed("component", "_c"), F.col("component") == F.col("_c"))
    chosen = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key") == F.col("_first")
    texts = kept_table(texts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), (~chosen).alias("gone"), "copies").where("gone or copies > 1"), "gone")
    repeated = texts.where("not gone")
    keyed = docs.select(*COLUMNS, text_key("text").alias("_text_key"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key"))
    out = keyed.join(texts.select("_id", "_key"), same, "left_anti").select(*COLUMNS)
    if repeated.isEmpty():
        return out
    once = keyed.join(repeated.select("_id", "_key"), same, "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return out.unionByName(once.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document has; a document of which nothing is left goes."""
    cut = substring_dedup.dedup_substrings(docs)
    return _shorter(cut.where("all_words = 0 or cut_words < all_words"), F.col("cut_words") > 0)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of the benchmark; a document that was nothing else goes."""
    cut = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.size("found_spans") > 0
    return _shorter(cut.where(~hit | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))), hit)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with how often, and the words that this makes."""
    rest = [c for c in COLUMNS if c != "doc_id"]
    return mixing.mix(docs, keep=rest).where("copies > 0").select("doc_id", *rest, "copies", "taken")


def _shorter(docs: DataFrame, cut: Column) -> DataFrame:
    return docs.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("mixing", source_weights),
]

#: The trained model of the first stage has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
