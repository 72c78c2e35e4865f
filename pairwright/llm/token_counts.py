"""Token counts of whole texts; huge texts are encoded as overlapping chunks and spliced.

Ordinary texts are encoded whole. A text of more than ``chunk`` code points is
cut into chunks that overlap by ``overlap`` code points; the chunks are rows, so
one text can keep many cores busy and no encoder ever holds a huge text.

Why a splice is right: the pre-tokenizer scans from left to right and looks at
most a few code points ahead, and merges never leave a pre-token. If a pre-token
of the left chunk, whose scan is that of the whole text, ends at p, and one of
the right chunk does too, both go on alike from p. Boundaries within ``MARGIN``
of the left chunk's end may depend on what was cut off and are not used (a
special string is shorter than that). With p the tokens of both halves add up:
all tokens of all chunks, less those of the left chunk from p on and those of the
right chunk before p. Where an overlap has no common boundary (a pre-token that
fills it), the text is done again with an overlap eight times as wide, at last as
a whole.

The chunks go through the ``tokenizers`` library, which gives offsets and
pre-token numbers. Whole texts go through the same vocabulary as a rank file,
which is four times as fast; that both give equal tokens is tested over texts
and over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, kept_table, lean, shuffle_width, text_key, union_all
from pairwright.llm.words import BLOCK, blocks

#: Code points at a chunk's end whose boundaries may depend on the text after it.
MARGIN = 16
CHUNK, OVERLAP, WIDER = 1 << 15, 256, 8

_COUNTED = "doc_id long, n_bytes long, n_tokens long"
_CHUNKS = "doc_id long, text_key long, n_bytes long, chunk int, n_chunks int, text string"
_ENDS = (
    "doc_id long, text_key long, n_bytes long, chunk int, n_chunks int, n_tokens long, "
    "head array<long>, before array<long>, tail array<long>, after array<long>"
)


def token_counts(
    docs: DataFrame, model: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens.

    ``model`` names a ``.json`` tokenizer and a ``.tiktoken`` rank file of one
    vocabulary among the public tokenizers. A null text counts as empty and has
    no tokens. Null ids and repeated rows are kept as they are. Other columns
    are not looked at.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    whole = rows.where(F.char_length("text") <= chunk).mapInArrow(lean(_whole(model)), _COUNTED)
    huge = rows.where(F.char_length("text") > chunk).withColumn("text_key", text_key("text"))
    done = [whole]
    while True:
        ends = kept_table(_encoded(huge, model, chunk, overlap), "token-ends")
        counted = kept_table(_spliced(ends), "token-sums")
        done.append(counted.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens", "copies").transform(_repeated))
        open_ = counted.where("n_tokens is null").select("doc_id", "text_key")
        if open_.isEmpty():
            return union_all(done)
        huge = huge.join(
            open_.withColumnRenamed("doc_id", "_d").withColumnRenamed("text_key", "_k"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")), "left_semi"
        )
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)


def _whole(model: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _rank_encoder(model)
        for b in blocks(batches, "text"):
            n = [len(ranks.encode(t, allowed_special="all")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def _rank_encoder(model: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{model}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    special = {t["content"]: t["id"] for t in _added(model)}
    return tiktoken.Encoding(model, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _added(model: str) -> list[dict]:
    import json

    import public_tokenizers

    with open(public_tokenizers.path(f"{model}.json"), encoding="utf-8") as f:
        return json.load(f)["added_tokens"]


def _json_encoder(model: str):
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task per core
    t = Tokenizer.from_file(public_tokenizers.path(f"{model}.json"))
    t.no_truncation()
    t.no_padding()
    return t


def _encoded(huge: DataFrame, model: str, chunk: int, overlap: int) -> DataFrame:
    """A row per chunk: its tokens, and the pre-token boundaries in its overlaps with the tokens on the far side."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in _CHUNKS.split(", ")]
        for b in blocks(batches, "text"):
            for row in b.to_pylist():
                text = row["text"]
                n = -(-len(text) // chunk)
                for first in range(0, n, max(1, BLOCK // chunk)):
                    rows = [
                        {**row, "chunk": k, "n_chunks": n, "text": text[k * chunk : (k + 1) * chunk + overlap]}
                        for k in range(first, min(n, first + max(1, BLOCK // chunk)))
                    ]
                    yield pa.RecordBatch.from_pydict(
                        {c: pa.array([r[c] for r in rows], pa.string() if c == "text" else pa.int32() if "chunk" in c else pa.int64()) for c in names}
                    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _json_encoder(model)
        for b in blocks(batches, "text"):
            out = []
            for row in b.to_pylist():
                text = row.pop("text")
                e = t.encode(text, add_special_tokens=False)
                head, before, tail, after = [], [], [], []
                at, words = e.offsets, e.word_ids
                lo = row["chunk"] * chunk
                last = row["chunk"] + 1 == row["n_chunks"]
                k = 0
                while row["chunk"] and k < len(at) and at[k][0] <= overlap - MARGIN:
                    if k == 0 or words[k] is None or words[k] != words[k - 1]:
                        head.append(lo + at[k][0])
                        before.append(k)
                    k += 1
                k = len(at) - 1
                while not last and k >= 0 and at[k][0] >= chunk:
                    if at[k][0] <= len(text) - MARGIN and (k == 0 or words[k] is None or words[k] != words[k - 1]):
                        tail.append(lo + at[k][0])
                        after.append(len(at) - k)
                    k -= 1
                out.append({**row, "n_tokens": len(at), "head": head, "before": before, "tail": tail, "after": after})
            kinds = {"chunk": pa.int32(), "n_chunks": pa.int32()} | dict.fromkeys(("head", "before", "tail", "after"), pa.list_(pa.int64()))
            names = [c.split(" ")[0] for c in _ENDS.split(", ")]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in out], kinds.get(c, pa.int64())) for c in names})

    chunks = huge.select("doc_id", "text_key", "n_bytes", "text").mapInArrow(lean(cut), _CHUNKS)
    return chunks.repartition(shuffle_width(huge.sparkSession), "doc_id", "text_key", "chunk").mapInArrow(lean(encode), _ENDS)


def _spliced(ends: DataFrame) -> DataFrame:
    """A row per text: its tokens (null where an overlap has no common boundary) and how many rows have it."""
    key = ["doc_id", "text_key"]
    one = ends.groupBy(*key, "chunk").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_bytes", "n_chunks", "n_tokens", "head", "before", "tail", "after")]
    )
    # Both halves of an overlap meet under the number of its left chunk.
    halves = one.select(*key, F.col("chunk").alias("at"), "tail", "after", F.lit(None).cast("array<long>").alias("head"), F.lit(None).cast("array<long>").alias("before")).where(
        "at < n_chunks - 1"
    ).unionByName(
        one.where("chunk > 0").select(
            *key, (F.col("chunk") - 1).alias("at"), F.lit(None).cast("array<long>").alias("tail"), F.lit(None).cast("array<long>").alias("after"), "head", "before"
        )
    )
    met = halves.groupBy(*key, "at").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("tail", "after", "head", "before")])
    p = F.try_element_at(F.array_intersect("tail", "head"), F.lit(1))
    twice = F.element_at("after", F.array_position("tail", p).cast("int")) + F.element_at("before", F.array_position("head", p).cast("int"))
    overlaps = met.select(*key, F.when(p.isNotNull(), -twice).alias("n"), p.isNull().alias("failed"), F.lit(None).cast("long").alias("copies"), F.lit(None).cast("long").alias("n_bytes"))
    parts = one.select(*key, F.col("n_tokens").alias("n"), F.lit(False).alias("failed"), F.when(F.col("chunk") == 0, F.col("copies")).alias("copies"), "n_bytes")
    return parts.unionByName(overlaps).groupBy(*key).agg(
        F.max("copies").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.when(~F.bool_or("failed"), F.sum("n")).alias("n_tokens")
    )


def _repeated(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_")).drop("_")
