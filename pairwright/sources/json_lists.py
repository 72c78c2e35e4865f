"""Large JSON documents that are lists, read by many tasks.

A document is a list of objects, or an object with the list under ``samples`` or
``pairs``. The text source cuts the file after every closing brace, so any byte range
can be read on its own. What a piece means depends on what comes before it: whether it
begins inside a string, and how deep in braces and brackets. Both are sums over the
pieces before, a number of quotes and a balance of brackets. They are summed inside each
split and over the splits, one row each; for the balance both cases are kept until
it is known whether the split begins inside a string. A piece that comes back to the
depth of the list ends an element. The pieces of an element, and never those of a
document, are put together and parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.operators.ranking import measured, with_columns_of
from pairwright.session import cut_lineage

LISTS = ("samples", "pairs")
#: One number holds both depths: braces in units of this, and square brackets in ones.
BRACE = 1 << 32


def _outside(piece: Column, inside: bool) -> Column:
    """What of a piece without escapes is not in strings, if it begins inside of one or not."""
    return F.regexp_replace(F.concat(F.lit('"'), piece) if inside else piece, r'"[^"]*+("|$)', "")


def _balance(outside: Column) -> Column:
    """Braces opened, in units of ``BRACE``, and square brackets opened less those closed."""
    left = lambda keep: F.length(F.regexp_replace(outside, keep, ""))
    return left(r"[^{]+") * F.lit(BRACE) + left(r"[^\[]+") - left(r"[^\]]+")


def _braces(depth: Column) -> Column:
    return F.shiftright(depth + BRACE // 2, BRACE.bit_length() - 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, _start, _id, piece, size, ..): pieces in the order of ``_id`` inside a split that starts at ``_start``."""
    meta = [F.col(f"_metadata.{n}").alias(n) for n in ("file_path", "file_size", "file_block_start")]
    raw = spark.read.option("lineSep", "}").text(path).select(*meta, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("piece"))
    raw = raw.withColumnsRenamed({"file_path": "file", "file_block_start": "_start"})
    plain = F.regexp_replace("piece", r"(?s)\\.", "")
    raw = raw.withColumn("_plain", plain)
    quotes = F.length("_plain") - F.length(F.replace(F.col("_plain"), F.lit('"'), F.lit("")))
    rows = raw.withColumn("_q", quotes.cast("bigint"))
    odd = F.col("_q") % 2 == 1
    for k in (0, 1):  # the brace at the end counts if it is outside of strings
        ends_outside = odd if k else ~odd
        rows = rows.withColumn(f"_b{k}", _balance(_outside(F.col("_plain"), bool(k)))).withColumn(f"_e{k}", F.when(ends_outside, F.lit(BRACE)).otherwise(0))
    return cut_lineage(rows.drop("_plain"), "json-pieces")


def _state(pieces: DataFrame) -> DataFrame:
    """Pieces with ``_in`` (they begin inside a string), ``_low`` and ``_depth``: depth before and after the brace that ends them."""
    split = W.partitionBy("file", "_start").orderBy("_id")
    before = split.rowsBetween(W.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    flip = sums("_q", before) % 2  # inside a string, if the split begins outside
    rows = pieces.withColumn("_flip", flip)
    for k in (0, 1):
        inside = F.col("_flip") == (1 - k)
        rows = rows.withColumn(f"_d{k}", F.when(inside, F.col("_b1") - F.col("_e1")).otherwise(F.col("_b0") - F.col("_e0")))
    # one row per split from here on
    per = rows.groupBy("file", "_start").agg(F.sum("_q").alias("_q"), F.sum("_d0").alias("_t0"), F.sum("_d1").alias("_t1"))
    files = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("_odd", sums("_q", files) % 2)
    per = per.withColumn("_deep", sums(F.when(F.col("_odd") == 1, F.col("_t1")).otherwise(F.col("_t0")), files)).select("file", "_start", "_odd", "_deep")
    rows = with_columns_of(rows, measured(per), ["file", "_start"])
    rows = rows.withColumn("_in", (F.col("_flip") + F.col("_odd")) % 2 == 1).withColumn("_step", F.when(F.col("_odd") == 1, F.col("_d1")).otherwise(F.col("_d0")))
    after = F.col("_deep") + F.sum("_step").over(split)
    end = F.when(F.col("_in"), F.col("_e1")).otherwise(F.col("_e0"))
    return rows.withColumn("_depth", after).withColumn("_low", after + end).withColumn("_from", after - F.col("_step"))


def read_json_lists(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    """One row per element of the lists of all documents at ``path``: file, no (from 0), element.

    A document that is cut off, has no such list, or has other things than objects
    in it is an error. Elements of lists under other names are left out.
    """
    state = cut_lineage(_state(_pieces(spark, path)), "json-state")
    first = state.where("_start = 0").groupBy("file").agg(F.min_by("piece", "_id").alias("_head"))
    bare = F.regexp_like("_head", F.lit(r"^\s*\["))
    whole = state.groupBy("file").agg(
        F.max("file_size").alias("_size"), F.sum(F.octet_length("piece") + F.lit(1)).alias("_seen"),
        F.max_by(F.struct("_depth", "_low"), F.struct("_start", "_id")).alias("_end"),
    )
    # the last piece has no brace behind it if the file does not end with one
    closed = F.when(F.col("_seen") == F.col("_size"), F.col("_end._depth")).otherwise(F.col("_end._low"))
    documents = first.join(whole, "file").select("file", F.when(bare, F.lit(1)).otherwise(F.lit(BRACE + 1)).cast("bigint").alias("_base"), (closed == 0).alias("_whole"), (F.col("_seen") > F.col("_size")).alias("_open_end"))
    rows = with_columns_of(state, measured(documents), ["file"])
    ends = ((F.col("_depth") == F.col("_base")) & (F.col("_low") > F.col("_depth"))).cast("bigint")
    rows = rows.withColumn("_ends", F.when(F.col("_whole"), ends).otherwise(F.raise_error(F.concat(F.lit("JSON document is cut off: "), "file")).cast("bigint")))
    split = W.partitionBy("file", "_start").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    per = rows.groupBy("file", "_start").agg(F.sum("_ends").alias("_n"))
    files = W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("file", "_start", F.coalesce(F.sum("_n").over(files), F.lit(0)).alias("_off"), F.sum("_n").over(W.partitionBy("file")).alias("_all"))
    rows = with_columns_of(rows, measured(per), ["file", "_start"])
    rows = rows.withColumn("no", F.col("_off") + F.coalesce(F.sum("_ends").over(split), F.lit(0)))
    # the pieces of an element in order; what follows the last one is not an element
    top = (_braces(F.col("_from")) <= _braces(F.col("_base"))).alias("_top")
    parts = rows.where("no < _all").groupBy("file", "no").agg(F.sort_array(F.collect_list(F.struct("_start", "_id", "piece", top))).alias("_parts"))
    # it begins in the last piece that does not begin inside of it; what is before belongs to other members of the document
    own = F.array_position(F.reverse(F.transform("_parts", lambda p: p["_top"])), True).cast("int")
    parts = parts.select("file", "no", F.transform(F.slice("_parts", -own, own), lambda p: p["piece"]).alias("_own"))
    text = parts.select("file", "no", F.concat(F.array_join("_own", "}"), F.lit("}")).alias("_text"))
    named = r'(?s)^.*?"([^"\\]*)"\s*:\s*\[\s*(?=\{)'
    plain = F.regexp_like("_text", F.lit(r"^[\s,]*\{")) & (F.col("no") > 0)
    head = F.when(plain, F.lit(None)).when(F.regexp_like("_text", F.lit(r"^\s*\[\s*\{")), F.lit("")).otherwise(F.regexp_extract("_text", named, 1))
    text = text.withColumn("_list", head)
    body = F.when(plain, F.regexp_replace("_text", r"^[\s,]+", "")).when(F.col("_list") == "", F.regexp_replace("_text", r"^\s*\[\s*", "")).otherwise(F.regexp_replace("_text", named, ""))
    text = cut_lineage(text.select("file", "no", "_list", body.alias("_body")), "json-elements")
    # a list's name is told with its first element only: one row per list
    begins = text.where("_list is not null").select("file", F.col("no").alias("_first"), "_list")
    until = W.partitionBy("file").orderBy("_first")
    begins = begins.withColumn("_next", F.lead("_first").over(until)).select(F.col("file").alias("_file"), "_first", "_next", F.col("_list").alias("_name"))
    on = (F.col("file") == F.col("_file")) & (F.col("no") >= F.col("_first")) & (F.col("_next").isNull() | (F.col("no") < F.col("_next")))
    named_rows = text.join(measured(begins), on).where(F.col("_name").isin("", *LISTS))
    parsed = F.from_json("_body", element, {"mode": "FAILFAST"})
    return named_rows.select("file", "no", parsed.alias("element"))
