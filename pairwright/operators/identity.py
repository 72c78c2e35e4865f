"""Duplicates, inserts, updates and lookups by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_per(df: DataFrame, key: str, pick, order: Column, copies: str | None) -> DataFrame:
    """One row per key through an aggregate.

    Unlike ``row_number() = 1`` it combines before the shuffle, so a key with a
    third of all rows sends one row per map task.
    """
    rest = [c for c in df.columns if c != key]
    extra = [F.count(F.lit(1)).alias(copies)] if copies else []
    out = df.groupBy(key).agg(pick(F.struct(*rest), order).alias("_row"), *extra)
    return out.select(key, "_row.*", *([copies] if copies else []))


def first_seen(df: DataFrame, key: str, order: Column, copies: str | None = None) -> DataFrame:
    """First row of every key in input order, optionally with the number of copies."""
    return _one_per(df, key, F.min_by, order, copies)


def last_seen(df: DataFrame, key: str, order: Column, copies: str | None = None) -> DataFrame:
    """Last row of every key: later rows overwrite earlier ones."""
    return _one_per(df, key, F.max_by, order, copies)


def insert_absent(store: DataFrame, batch: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows of the batch to add: first of each new key. The store has each key once."""
    return first_seen(batch, key, order).join(store.select(key), key, "left_anti")


def insert_counts(store: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: added and duplicates."""
    keys = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = store.select(key, F.lit(True).alias("_known"))
    marked = keys.join(known, key, "left")
    added = F.count_if(F.col("_known").isNull())
    return marked.agg(added.alias("added"), (F.coalesce(F.sum("_n"), F.lit(0)) - added).alias("duplicates"))


def update_present(store: DataFrame, updates: DataFrame, key: str, order: Column) -> DataFrame:
    """Store rows, replaced by the last update of their key; keys not in the store are ignored."""
    new = last_seen(updates, key, order)
    cols = [c for c in store.columns if c != key]
    packed = new.select(key, F.struct(*cols).alias("_new"))
    joined = store.join(packed, key, "left")
    return joined.select(
        key, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in cols]
    )


def present_in(df: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the store."""
    return df.join(store.select(key).distinct(), key, "left_semi")


def override_by_key(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Base rows whose key the override does not define, plus all override rows."""
    return base.join(override.select(key).distinct(), key, "left_anti").unionByName(override)
