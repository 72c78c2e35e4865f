"""Texts and rows that several tests use."""

import random


def prose(seed: int, n: int, vocabulary: int = 3000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Null ids and texts, empty and blank texts, a very long one, repeated rows, one id with two texts.
def odd_rows():
    base = prose(1, 200)
    long = prose(2, 60_000, 50_000)
    return [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (6, "one two"), (7, "one two"), (None, base), (None, None), (None, prose(3, 80)),
        (8, long), (9, long + " tail"), (10, prose(4, 40)), (10, prose(5, 40)), (11, "a\x00b c d \U0001f600 é" * 3), (12, "x" * 300_000),
        (13, base.upper()), (14, f"{prose(6, 30)} {base[:400]} {prose(7, 30)}"), (15, (prose(8, 20) + "\n") * 5),
    ]


def same_hash(spark, a, b):
    """A text that begins with ``a`` and one that begins with ``b``, of equal 32-bit hash."""
    from pyspark.sql import functions as F

    one, two = (spark.range(400_000).select(F.concat(F.lit(f"{x} x"), F.col("id")).alias(n)).withColumn("h", F.hash(n)) for x, n in ((a, "a"), (b, "b")))
    r = one.join(two, "h").first()
    return r["a"], r["b"]
