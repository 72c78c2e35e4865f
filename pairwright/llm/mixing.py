"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a hash of its id, as hexadecimal digits. A histogram adds up
the sizes by source and by the first digits; in it lies the bucket in which a
source's budget ends. Only the documents of that bucket are looked at again, by
the next digits, until the bucket holds one hash. The thresholds are nested: a
larger budget takes all that a smaller one takes. Documents below the threshold
are taken once more than those above.

Buckets are joined by source and bucket together, so a source with a third of all
rows is spread over all its buckets. A histogram has ``16 ** DIGITS`` rows for a
source at most, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.frames import kept_table, others

#: Hexadecimal digits that one histogram looks at.
DIGITS = 3
HASH_DIGITS = 32
WEIGHTS = (3, 1, 2)
#: Budget over all sizes, and most copies of a document.
SHARE, MOST = 1.5, 2
RESULT = ("doc_id", "size", "source_size", "target", "copies", "taken")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text without making them: separators become one blank, the rest one letter."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "a"), r"[^a]+", "")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same and target: shares of the budget by weight, cut at ``most`` times a source's size.

    Weights go to the sources by code point, repeating, null last. What a cut
    leaves over goes to the others by weight, until none is above its cut: each
    round fixes the sources that are above and computes the level of the others.
    A round moves three numbers to the driver.
    """
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = kept_table(sizes.withColumn("weight", weight), "mix-sources")
    level, fixed = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("source_size") * most
        n, open_weight, spent, total = s.agg(
            F.count_if(full), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0.0)), F.sum("source_size")
        ).first()
        if n == fixed or not open_weight:
            break
        fixed, level = n, (share * total - spent) / open_weight
    return s.select("source", "source_size", F.least(F.col("weight") * level, F.col("source_size") * float(most)).alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None,
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, digits: int = DIGITS, keep: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``keep``, size, source_size, target, copies, taken (size times copies).

    Columns to ``keep`` that are named like another result are left out. ``size`` is the word count of ``text`` if not given; a null counts as 0. Null
    is a source of its own. Rows of one source with one id and one text (if there is
    a column ``text``) have one hash and are taken together; a null id is told apart
    by the text alone. The last hash of a source is taken if
    that brings the sum nearer to the target (a tie leaves it). An empty table
    gives an empty one. Reruns agree.
    """
    words = F.coalesce(size, F.lit(0)).cast("long") if size is not None else word_count(F.col("text"))
    told = [F.coalesce(F.col(id_col).cast("string"), F.lit(""))]
    if "text" in docs.columns:
        told += [F.lit("/"), F.md5(F.coalesce(F.col("text"), F.lit("")))]
    named = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), F.md5(F.concat(*told)).alias("hash"),
        F.struct(F.lit(0).alias("_"), *others(docs.select(*keep), "_", *RESULT)).alias("kept"),
    )
    narrow = kept_table(named.select("doc_id", "source", "size", "hash"), "mix-sizes")
    all_ = named if keep else narrow.withColumn("kept", F.struct(F.lit(0).alias("_")))
    targets = kept_table(source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    # Whole rounds that a source's target holds, and what is left for the threshold.
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = targets.withColumn("rounds", rounds).withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size"))
    cuts = _thresholds(narrow, plan, digits)
    last = cuts.select(F.col("source").alias("_s"), "source_size", "target", "rounds", "last")
    taken = all_.join(F.broadcast(last) if _few(last) else last, F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("rounds") + F.coalesce(F.col("hash") <= F.col("last"), F.lit(False)).cast("int")
    return taken.select("doc_id", "kept.*", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")).drop("_")


#: Sources up to which their thresholds are broadcast: rows of some 100 bytes.
FEW = 10_000


def _few(sources: DataFrame) -> bool:
    return sources.count() <= FEW


def _thresholds(narrow: DataFrame, plan: DataFrame, digits: int) -> DataFrame:
    """plan with ``last``: the greatest hash of each source that is taken once more (null: none)."""
    open_ = plan.where(F.col("left") > 0).select("source", "left")
    rest, closed, at = narrow.select("source", "size", "hash"), [], 0
    while True:
        width = min(digits, HASH_DIGITS - at)
        # The documents of the buckets that are still open, by the next digits.
        cut = F.substring("hash", 1, at + width)
        sums = rest.groupBy("source", cut.alias("prefix")).agg(
            F.sum("size").alias("n"), F.max("hash").alias("high"), (F.min("hash") == F.max("hash")).alias("single")
        )
        before = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        step = kept_table(
            sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("below", F.max("high").over(before))
            .join(open_.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"),
            "mix-step",
        )
        inside = (F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left"))
        edge = step.where(inside)
        nearer = F.col("before") + F.col("n") - F.col("left") < F.col("left") - F.col("before")
        # A bucket of one hash ends the search; ``below`` are hashes of this level's buckets, earlier levels' are in ``closed``.
        closed.append(step.where(~inside & (F.col("before") + F.col("n") <= F.col("left"))).groupBy("source").agg(F.max("high").alias("last")))
        closed.append(edge.where("single").select("source", F.when(nearer, F.col("high")).alias("last")))
        more = edge.where("not single")
        if more.isEmpty():
            break
        open_ = more.select("source", (F.col("left") - F.col("before")).alias("left"))
        # Joined by source and bucket: a hot source is spread over its buckets.
        keys = more.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
        rest = kept_table(rest.join(keys, F.col("source").eqNullSafe(F.col("_s")) & (cut == F.col("_p")), "left_semi"), "mix-rest")
        at += width
    found = closed[0]
    for c in closed[1:]:
        found = found.unionByName(c)
    found = found.groupBy(F.col("source").alias("_s")).agg(F.max("last").alias("last"))
    return kept_table(plan.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-cuts")
