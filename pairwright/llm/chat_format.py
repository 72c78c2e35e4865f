"""Chat formatting by columnar byte assembly, and its exact reversal.

One turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every
``<`` that is followed by backslashes (or none) and ``|`` gets one backslash more,
so a control string can only come from the template; roles also have their
backslashes and line breaks escaped. Taking one backslash away restores the text.

Segment lengths, cumulative offsets and scatter indices are numpy arrays over all
turns of a batch; headers and contents are copied into one buffer that becomes
the Arrow column as it is.

Turns are dealt by ranges of conversations and sorted (Spark spills), then
streamed: a conversation of any length leaves as parts of about ``PART`` bytes, in
order, so no task holds a whole one. A conversation of more than ``LARGE`` bytes
is dealt by ranges of its turns, so that many tasks format it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, kept_table, lean, shuffle_width
from pairwright.llm.words import blocks, code_points, ragged, string_array, text_buffer

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Role whose texts are under the loss mask.
LEARNED = "assistant"
#: Bytes of one part of a conversation, more or less; bytes from which a conversation is dealt by its turns, and what a
#: turn counts beside its text; characters of a text that ranges of equal turns and roles are told apart by.
PART, LARGE, TURN, EDGE = 4 << 20, 64 << 20, 32, 64

FORMATTED = "conv_id long, part long, n_turns long, text string, loss array<struct<start:int,stop:int>>"
_LOSS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one backslash more between ``<`` and ``|`` (and the backslashes between them)."""
    bars = np.flatnonzero(data == 0x7C)
    floor = offsets[np.searchsorted(offsets, bars, "right") - 1]  # where the bar's text begins
    at = bars - 1
    walk = np.arange(len(bars))
    while len(walk):
        walk = walk[(at[walk] >= floor[walk]) & (data[np.maximum(at[walk], 0)] == 0x5C)]
        at[walk] -= 1
    opens = (at >= floor) & (data[np.maximum(at, 0)] == 0x3C)
    inserts = at[opens] + 1  # the new backslash stands before this byte
    out = np.full(len(data) + len(inserts), 0x5C, np.uint8)
    out[np.arange(len(data)) + np.searchsorted(inserts, np.arange(len(data)), "right")] = data
    return out, offsets + np.searchsorted(inserts, offsets, "left")


def escaped_role(role: str) -> str:
    return re.sub(r"<(\\*\|)", r"<\\\1", role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*\|)", r"<\1", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list]:
    """Formatted texts of the groups of turns that begin at ``first``, and their spans of learned text in code points."""
    body, body_at = escaped(*text_buffer(texts))
    names = roles.fill_null("").dictionary_encode()
    heads = [START + escaped_role(r).encode() + b"\n" for r in names.dictionary.to_pylist()]
    which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Sources: all headers, the end mark, then the contents.
    sizes = np.array([len(h) for h in heads] + [len(END)], np.int64)
    source = np.concatenate([np.frombuffer(b"".join(heads) + END, np.uint8), body])
    at = np.concatenate([[0], np.cumsum(sizes)])
    n = len(texts)
    starts = np.stack([at[which], body_at[:-1] + at[-1], np.full(n, at[-2])], axis=1).ravel()
    lengths = np.stack([sizes[which], np.diff(body_at), np.full(n, len(END))], axis=1).ravel()
    out = np.empty(int(lengths.sum()), np.uint8)
    begin = np.cumsum(lengths) - lengths
    out[np.repeat(begin, lengths) + ragged(lengths)] = source[np.repeat(starts, lengths) + ragged(lengths)]
    edge = np.append(begin[0::3], len(out)) if n else np.zeros(1, np.int64)
    group = np.append(edge[first], len(out))
    # Code points before each content, counted from its group's begin.
    points = np.concatenate([[0], np.cumsum(code_points(out))])
    owner = np.searchsorted(first, np.arange(n), "right") - 1
    a = points[begin[1::3]] - points[group[owner]]
    e = a + points[begin[1::3] + lengths[1::3]] - points[begin[1::3]]
    learned = np.array([r == LEARNED for r in names.dictionary.to_pylist()], bool)[which] if n else np.zeros(0, bool)
    spans: list[list[dict]] = [[] for _ in first]
    for k, x, y in zip(owner[learned].tolist(), a[learned].tolist(), e[learned].tolist(), strict=True):
        spans[k].append({"start": x, "stop": y})
    return string_array(out, np.diff(group)), spans


def format_chats(turns: DataFrame, part: int = PART, large: int = LARGE) -> DataFrame:
    """Rows of turns -> FORMATTED: for each conversation its parts in the order of ``part``.

    A part is one training text: its turns in order, ``loss`` the spans (code
    points) of the learned role's texts. Parts are numbered from 0; those of a
    conversation of more than ``large`` bytes are numbered with the range of its
    turns in the upper 32 bits, so numbers have gaps and a range may end a part
    early. Null roles and texts are empty. Turns with equal number are ordered by
    role and text, nulls first; repeated rows stay. Rows without conversation id
    are one conversation, null. Other columns are not looked at.
    """
    spark = turns.sparkSession
    bounded(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + TURN)
    wide = kept_table(rows.groupBy("conv_id").agg(size.alias("size")).where(F.col("size") > large).select(F.col("conv_id").alias("_wide"), F.lit(True).alias("by_turn")), "large")
    rows = rows.join(wide, F.col("conv_id").eqNullSafe(F.col("_wide")), "left").drop("_wide")
    # Keys that are null for all other conversations keep each of them in one range.
    edges = [F.when(F.col("by_turn"), c) for c in (F.col("turn"), F.col("role"), F.left("text", F.lit(EDGE)))]
    dealt = rows.repartitionByRange(shuffle_width(spark), F.col("conv_id"), *edges)
    numbered = dealt.withColumn("range", F.when(F.col("by_turn"), F.spark_partition_id()).otherwise(0)).drop("by_turn")
    return numbered.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lean(_formatter(part)), FORMATTED)


def _formatter(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last conversation so far, if it is short: it may go on
        open_: tuple | None = None  # conversation of which parts have left, and how many
        for b in blocks(batches, "text", limit):
            if held is not None:
                b = pa.concat_batches([held, b])
            column = b.column(b.schema.get_field_index("conv_id"))
            null, ids = column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))
            sizes = text_buffer(b.column(b.schema.get_field_index("text")))[1]
            long = sizes[-1] - sizes[first[-1]] >= limit
            numbers = np.zeros(len(first), np.int64)
            if open_ is not None and open_[:2] == (ids[0], null[0]):
                numbers[0] = open_[2]
            ready = first if long else first[:-1]
            if len(ready):
                yield _parts(b if long else b.slice(0, first[-1]), ready, numbers[: len(ready)])
            held = None if long else b.slice(first[-1])
            open_ = (ids[-1], null[-1], int(numbers[-1]) + long)
        if held is not None:
            yield _parts(held, np.zeros(1, np.int64), np.array([open_[2]], np.int64))

    return run


def _parts(b: pa.RecordBatch, first: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    get = {n: b.column(k) for k, n in enumerate(b.schema.names)}
    text, loss = assemble(get["role"], get["text"], first)
    numbers = numbers + (get["range"].take(pa.array(first)).to_numpy().astype(np.int64) << 32)
    turns = np.diff(np.append(first, len(b)))
    return pa.RecordBatch.from_arrays(
        [get["conv_id"].take(pa.array(first)), pa.array(numbers), pa.array(turns), text, pa.array(loss, _LOSS)], ["conv_id", "part", "n_turns", "text", "loss"]
    )


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text as (role, text)."""
    start, end = START.decode(), END.decode()
    turns = []
    for turn in text.split(end)[:-1]:
        role, body = turn.removeprefix(start).split("\n", 1)
        turns.append((unescaped_role(role), unescaped(body)))
    return turns


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted parts, a row per conversation; parts stream in order, hashes go on from part to part.

    A digest is one chain over a conversation, so this alone stays with one task for each, which holds a part at a time.
    """
    parts = formatted.repartition(shuffle_width(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    names = [c.split(" ")[0] for c in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now = None
        for b in blocks(batches, "text"):
            for row in b.to_pylist():
                if now is None or now[0] != row["conv_id"]:
                    if now is not None:
                        done.append(_closed(now))
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = row["text"]
                turns = read_back(text)
                now[1] += len(turns)
                for role, body in turns:
                    now[2].update(f"{role}\n{body}\n".encode())
                for span in row["loss"]:
                    learned = unescaped(text[span["start"] : span["stop"]])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += len(text)
            if len(done) > 1000:
                yield pa.RecordBatch.from_pydict({n: [d[k] for d in done] for k, n in enumerate(names)}, _DIGEST_KINDS)
                done = []
        if now is not None:
            done.append(_closed(now))
        if done:
            yield pa.RecordBatch.from_pydict({n: [d[k] for d in done] for k, n in enumerate(names)}, _DIGEST_KINDS)

    return parts.mapInArrow(lean(run), DIGESTS)


_DIGEST_KINDS = pa.schema([(c.split(" ")[0], pa.string() if c.endswith("string") else pa.int64()) for c in DIGESTS.split(", ")])


def _closed(now: list) -> tuple:
    return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]
