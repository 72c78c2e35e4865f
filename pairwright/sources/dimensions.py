"""Vocabulary and template dimensions from configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright import schemas
from pairwright.operators.identity import override_by_key
from pairwright.operators.ranking import measured

_DOMAINS = T.MapType(T.StringType(), schemas.DOMAIN_FILE)


def read_domains(spark: SparkSession, path: str, field: str = "domains") -> DataFrame:
    """(domain, agents, atoms) from a document {field: {domain: {agents: [..], atoms: {..}}}}."""
    outer = T.StructType([T.StructField(field, _DOMAINS)])
    raw = spark.read.schema(outer).option("multiLine", True).json(path)
    return raw.select(F.explode(field).alias("domain", "d")).select("domain", "d.agents", "d.atoms")


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Template rows from a document {"templates": [..]}."""
    outer = T.StructType([T.StructField("templates", T.ArrayType(schemas.SHAPE_FILE))])
    raw = spark.read.schema(outer).option("multiLine", True).json(path)
    return raw.select(F.explode("templates").alias("t")).select("t.*")


def merged_domains(base: DataFrame, override: DataFrame) -> DataFrame:
    """Domains of the override replace base domains of the same name."""
    return override_by_key(base, override, "domain")


def domain_agents(domains: DataFrame) -> DataFrame:
    return domains.select("domain", F.explode("agents").alias("agent"))


def domain_atoms(domains: DataFrame) -> DataFrame:
    return domains.select("domain", F.explode("atoms").alias("atom", "phrase"))


def shared_domains(train: DataFrame, test: DataFrame) -> DataFrame:
    """Domains on both sides; empty when the test set is a real generalisation check."""
    return train.select("domain").intersect(test.select("domain"))


def only_in_test(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.select("domain").distinct().join(train.select("domain").distinct(), "domain", "left_anti")


def attach_domain(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Domain vocabulary next to each row.

    The dimension is one row per domain. Its size is measured first, so a small
    one is broadcast and rows of a frequent domain never meet in one task.
    """
    return rows.join(measured(domains), "domain", "left")
