"""Not-modified revisit records resolved to the full responses that they stand for.

A revisit has the headers of a 304 answer and no body. It is resolved to the
latest earlier full response of its canonical url: an as-of join. Captures are
dealt by ranges of (url, date, id), so the captures of one hot url are spread over
many tasks; a window inside each range finds the last response before each
revisit, and a second, small window over ranges carries the last response into the
ranges behind it. Then validators are compared, and the headers that a 304 may
renew replace the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.frames import kept_table, shuffle_width

#: Headers that describe the stored body or one connection; a 304 does not renew them.
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-location", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Types of the columns that are looked at.
CAPTURE = "record_id long, kind string, url string, date timestamp, status int, headers array<struct<name:string,value:string>>, payload_digest string, body string"


def canonical(url: Column) -> Column:
    """Scheme, ``www.``, default port and fragment go, the host is lower-cased, query parameters are sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)?$", "")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    return F.concat(
        host, F.when(path == "", F.lit("/")).otherwise(path),
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    )


def header(headers: Column, name: str) -> Column:
    """The first value of a header, trimmed; names do not heed case."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.trim(F.try_element_at(hits, F.lit(1))["value"])


def merged(stored: Column, fresh: Column) -> Column:
    """Stored headers in order, without those that the 304 renews, then the renewing ones in order."""
    renews = F.filter(F.coalesce(fresh, F.array()), lambda h: F.coalesce(~F.lower(h["name"]).isin(*KEPT_HEADERS), F.lit(False)))
    names = F.transform(renews, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(F.coalesce(stored, F.array()), lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), renews)


def _bare(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def resolve(captures: DataFrame, carry: tuple[str, ...] = ("body",)) -> DataFrame:
    """One row per revisit: record_id, url_key, outcome, response_id, date, status, headers, and ``carry`` of the response.

    A full response is a row of kind ``response`` with status 200 and a date; the
    one used is the latest with an earlier date, of equal dates the one with the
    greatest id. Outcomes: ``resolved``; ``mismatch`` or ``no_validator``, with
    response_id but nothing merged; ``no_response``. The first validator that both
    have decides: payload digest, ETag (weakly), Last-Modified. Revisits without
    url or date have no response. Ids are taken to be unique; rows that repeat an
    id as responses give one result (the least by its columns), repeated revisits
    one each. Other columns are not looked at.
    """
    width = shuffle_width(captures.sparkSession)
    c = captures.withColumn("url_key", canonical(F.col("url")))
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200) & F.col("date").isNotNull(), F.lit(False))
    validators = F.struct(
        F.col("date").alias("t"), F.col("record_id").alias("id"), F.col("payload_digest").alias("digest"),
        _bare(header(F.col("headers"), "etag")).alias("etag"), header(F.col("headers"), "last-modified").alias("modified"),
    )
    events = c.where(full | (F.col("kind") == "revisit")).select("url_key", "date", F.col("record_id").alias("id"), full.alias("full"), validators.alias("own"))
    # At equal dates revisits come first: they see only earlier responses.
    dealt = events.repartitionByRange(width, "url_key", "date", "full", "id").withColumn("chunk", F.spark_partition_id())
    dealt = kept_table(dealt, "captures")
    inside = Window.partitionBy("url_key", "chunk").orderBy(F.col("date").asc_nulls_first(), "full", "id")
    local = dealt.withColumn("last", F.last(F.when(F.col("full"), F.col("own")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = dealt.where("full").groupBy(F.col("url_key").alias("_u"), F.col("chunk").alias("_c")).agg(F.max("own").alias("end"))
    # One row for each url and range: a hot url has as many as there are ranges.
    chunks = dealt.select(F.col("url_key").alias("_u"), F.col("chunk").alias("_c")).distinct().join(ends, ["_u", "_c"], "left")
    carried = chunks.withColumn("carried", F.last("end", ignorenulls=True).over(Window.partitionBy("_u").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)))
    revisits = local.where("not full").join(carried.where("carried is not null"), (F.col("url_key") == F.col("_u")) & (F.col("chunk") == F.col("_c")), "left")
    found = F.when(F.col("date").isNotNull() & F.col("url_key").isNotNull(), F.coalesce(F.col("last"), F.col("carried")))
    matched = revisits.select(F.col("id").alias("record_id"), "url_key", "date", found.alias("ref"), "own")
    same = [F.col(f"own.{v}") == F.col(f"ref.{v}") for v in ("digest", "etag", "modified")]
    checked = F.coalesce(*same)
    outcome = F.when(F.col("ref").isNull(), "no_response").when(checked.isNull(), "no_validator").when(checked, "resolved").otherwise("mismatch")
    matched = matched.select("record_id", "url_key", "date", F.col("ref.id").alias("response_id"), outcome.alias("outcome"), F.col("own").alias("_own"))
    # Headers and body of each revisit and of the response that it resolves to.
    fresh = c.where("kind = 'revisit'").select(F.col("record_id").alias("_r"), F.col("url_key").alias("_u"), F.col("date").alias("_d"), F.col("headers").alias("fresh"), validators.alias("_v"))
    matched = matched.distinct().join(
        fresh, F.col("record_id").eqNullSafe(F.col("_r")) & F.col("url_key").eqNullSafe(F.col("_u")) & F.col("date").eqNullSafe(F.col("_d")) & F.col("_own").eqNullSafe(F.col("_v"))
    ).drop("_r", "_u", "_d", "_own", "_v")
    stored = c.where(full).select(F.col("record_id").alias("_r"), F.col("status").alias("_s"), F.col("headers").alias("stored"), *[F.col(x).alias(f"_{x}") for x in carry])
    stored = stored.groupBy("_r").agg(F.min(F.struct("_s", "stored", *[f"_{x}" for x in carry])).alias("_full"))
    # What is not resolved finds nothing, and is dealt by its own columns instead of one null key.
    resolved = F.col("outcome") == "resolved"
    spread = F.when(resolved, 0).otherwise(F.pmod(F.hash("record_id", "url_key", "date"), F.lit(1 << 20)) + 1)
    hit = matched.withColumn("_use", F.when(resolved, F.col("response_id"))).withColumn("_spread", spread)
    joined = hit.join(stored.withColumn("_zero", F.lit(0)), (F.col("_use") == F.col("_r")) & (F.col("_spread") == F.col("_zero")), "left")
    return joined.select(
        "record_id", "url_key", "outcome", "response_id", "date", F.col("_full._s").alias("status"),
        F.when(F.col("_full").isNotNull(), merged(F.col("_full.stored"), F.col("fresh"))).alias("headers"), *[F.col(f"_full._{x}").alias(x) for x in carry],
    )
