"""Quality rules: plain counts, and a logistic regression on hashed word and character n-grams.

The regression is trained on labelled rows, calibrated on labelled rows that it
did not see, and scored in Arrow batches. A text's features are the shares of its
hashed n-grams, by family; a score is the sum of two gathers over the text's
n-grams and needs no dictionary. Training uses at most ``SAMPLE`` labelled rows of
each class, those with the smallest hashed ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.frames import bounded, lean, lean_group, others, send
from pairwright.llm.words import Words, blocks, chained, code_points, covered, fingerprints, mix, runs, spaced, words_of

#: Base rules: fewer words fail, and more than this share (percent) of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, REPEAT = 50, 50, 3
#: Fixed symbols that are counted.
SYMBOLS = b"#*$%&|<>"
#: Labelled rows of each class, buckets of hashed n-grams, lengths of word and character n-grams.
SAMPLE, BUCKETS, WORD_GRAMS, CHAR_GRAMS = 1024, 1 << 18, (1, 2), (2, 4)
#: Weight of a family's shares, strength of the penalty, rounds of training, one of so many sampled rows calibrates.
SCALE, PENALTY, ROUNDS, FOLDS = 20.0, 1e-4, 120, 4
#: Probability of good quality from which a row is kept.
THRESHOLD = 0.5


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur again."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else False
    return out


def base_counts(w: Words, window: int = REPEAT) -> dict[str, np.ndarray]:
    """The plain counts of each text of a block."""
    n = len(w.bounds) - 1
    rows = w.rows

    def by_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offsets])

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # Lines with a word; the first of equal lines of a text is none too many.
    a, e = runs(w.data != 0x0A, w.offsets)
    lined = np.searchsorted(w.starts, a) < np.searchsorted(w.starts, e)
    a, e = a[lined], e[lined]
    line_row = np.searchsorted(w.offsets, a, "right") - 1
    key = mix(fingerprints(w.data, a, e) + line_row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order][1:] == key[order][:-1]]
    at = w.windows(window)
    twice = at[repeated(mix(chained(w.hashes, at, window) + rows[at].astype(np.uint64)))]
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": by_row(code_points(w.data) & spaced()[w.data]).astype(np.int64),
        "n_symbols": by_row(symbol[w.data]).astype(np.int64),
        "n_dup_lines": np.bincount(line_row[again], minlength=n).astype(np.int64),
        "n_repeat_words": np.bincount(rows[covered(len(w.starts), twice, window)], minlength=n).astype(np.int64),
    }


def grams(w: Words, words: tuple[int, ...] = WORD_GRAMS, chars: tuple[int, ...] = CHAR_GRAMS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: (text, bucket) of all occurrences, texts in order. Character n-grams are over bytes, within a text."""
    rows = w.rows
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for k, n in enumerate(words):
        at = w.windows(n)
        yield rows[at], (mix(chained(w.hashes, at, n) + np.uint64(k)) >> shift).astype(np.int64)
    row = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
    for k, n in enumerate(chars):
        m = max(0, len(w.data) - n + 1)
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = (h << np.uint64(8)) | w.data[j : j + m]
        inside = row[:m] == row[n - 1 : n - 1 + m]
        yield row[:m][inside], (mix(h[inside] + np.uint64((k + 1) << 40)) >> shift).astype(np.int64)


@dataclass
class Model:
    """Weights of the buckets, intercept, and the calibration of the raw score."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def probability(self, w: Words) -> np.ndarray:
        """Probability of good quality of each text."""
        n = len(w.bounds) - 1
        z = np.full(n, self.bias)
        for row, bucket in grams(w):
            total = np.bincount(row, minlength=n)
            z += SCALE * np.bincount(row, self.weights[bucket], minlength=n) / np.maximum(total, 1)
        return _sigmoid(self.slope * z + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``sample`` labelled texts of each class as (id, good, text), and how many rows of each class there are.

    An id that is labelled twice counts as good if all its labels do. Rows
    without id or label are no labels.
    """
    one = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good is not null")
        .groupBy("id").agg(F.min((F.col("good") != 0).cast("int")).alias("good"))
    )
    have = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct().join(one, "id")
    sizes = {r["good"]: r["n"] for r in have.groupBy("good").agg(F.count("*").alias("n")).collect()}
    # The smallest hashed ids: two short lists, taken without sorting the rest.
    lists = [have.where(F.col("good") == g).orderBy(F.xxhash64("id"), "id").limit(sample) for g in (0, 1)]
    ids = F.broadcast(lists[0].unionByName(lists[1]))  # 2 * sample rows of two numbers
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(ids, "id").select("id", "good", "text"), sizes


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of each text and their values, in order of the buckets."""
    for b in blocks(batches, "text"):
        w = words_of(b.column("text"), spaced())
        n = len(b)
        found, value = [], []
        for row, bucket in grams(w):
            key, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
            found.append(key)
            value.append(SCALE * counts / np.bincount(row, minlength=n)[key // BUCKETS])
        key, slot = np.unique(np.concatenate(found), return_inverse=True)
        values = np.bincount(slot, np.concatenate(value), minlength=len(key)).astype(np.float32)
        begin = np.searchsorted(key // BUCKETS, np.arange(n + 1))
        buckets = (key % BUCKETS).astype(np.int32)
        cut = list(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("good"), pa.array([buckets[a:e].tobytes() for a, e in cut], pa.binary()), pa.array([values[a:e].tobytes() for a, e in cut], pa.binary())],
            ["id", "good", "buckets", "values"],
        )


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """The calibrated regression, or None if a class has no rows.

    Gradient steps with momentum over the sampled rows; every ``FOLDS``-th row of
    the sample is held back and calibrates, weighted to the shares that the
    classes have among all labelled rows. The sample's features, ``2 * sample``
    rows, go to one task; the driver gets the weights alone.
    """
    texts, sizes = labelled_sample(docs, labels, id_col, text_col, label_col, sample)
    if len(sizes) < 2:
        return None
    schema = f"id {dict(texts.dtypes)['id']}, good int, buckets binary, values binary"
    fit = lean_group(lambda rows: _trained(rows, sizes))
    found = texts.mapInArrow(lean(_features), schema).groupBy().applyInArrow(fit, "weights binary, bias double, slope double, offset double").first()
    return None if found is None else Model(np.frombuffer(found["weights"], np.float32), found["bias"], found["slope"], found["offset"])


def _trained(table: pa.Table, sizes: dict[int, int]) -> pa.Table:
    """The model of the sampled rows, as one row."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["good"], str(r["id"]), r["buckets"]))
    good = np.array([r["good"] for r in rows], float)
    held = np.arange(len(rows)) % FOLDS == 0
    if min((good[~held] == 0).sum(), (good[~held] == 1).sum()) == 0:
        held[:] = False
    bucket = np.concatenate([np.frombuffer(r["buckets"], np.int32) for r in rows])
    value = np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r["buckets"]) // 4 for r in rows])
    del rows
    weights, bias = _fit(bucket, value, row, good, ~held)
    z = np.bincount(row, value * weights[bucket], minlength=len(good)) + bias
    use = held if held.any() else np.ones(len(good), bool)
    share = np.where(good == 1, sizes[1] / max(1, (good[use] == 1).sum()), sizes[0] / max(1, (good[use] == 0).sum()))
    slope, offset = _calibrated(z[use], good[use], share[use])
    return pa.table({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "bias": [bias], "slope": [float(slope)], "offset": [float(offset)]})


def _fit(bucket: np.ndarray, value: np.ndarray, row: np.ndarray, good: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, float]:
    weights, bias = np.zeros(BUCKETS), 0.0
    share = np.where(good == 1, 0.5 / max(1, (good[use] == 1).sum()), 0.5 / max(1, (good[use] == 0).sum())) * use
    # Adam's two averages; the penalty draws weights that no row needs to 0.
    m, v = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, value * weights[bucket], minlength=len(good)) + bias
        miss = (_sigmoid(z) - good) * share
        g = np.append(np.bincount(bucket, value * miss[row], minlength=BUCKETS) + PENALTY * weights, miss.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def _calibrated(z: np.ndarray, good: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """Platt scaling by Newton steps, with targets drawn in from 0 and 1 by the class sizes, so that separable scores stay finite."""
    n1, n0 = (good == 1).sum(), (good == 0).sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = share / share.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        d, h = (p - target) * share, p * (1 - p) * share + 1e-12
        g = np.array([(d * z).sum(), d.sum()])
        hess = np.array([[(h * z * z).sum() + 1e-9, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -5, 5)
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` with the counts, the probability of good quality and ``kept``; columns of these names are replaced.

    ``kept`` is false if a base rule fails or the probability is below
    ``threshold``. A null text has no words and fails. Without labels of both
    classes the probability is null and only the base rules decide. Repeated rows
    get equal results; a null id is never labelled.
    """
    spark = docs.sparkSession
    bounded(spark)
    model = train(docs, labels, id_col, text_col, label_col, sample)
    sent = send(spark, model)  # BUCKETS floats
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    own = others(docs, *names)
    rows = docs.select(*own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**sent.value) if sent.value else None
        for b in blocks(batches, text_col):
            w = words_of(b.column(b.schema.get_field_index(text_col)), spaced())
            c = base_counts(w)
            failed = (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
            p = model.probability(w) if model else None
            kept = ~failed if p is None else ~failed & (p >= threshold)
            new = [*[pa.array(c[n]) for n in names[:5]], pa.array(failed), pa.nulls(len(b), pa.float64()) if p is None else pa.array(p), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(run), f"{fields}, {COLUMNS}")
