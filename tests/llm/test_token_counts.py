import pytest

from cases import odd_rows, prose

from pairwright.llm import token_counts as tc


def brute(texts):
    t = tc._json_encoder("byte_bpe_50k")
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def rows_of(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in df.collect())


def want(rows):
    counts = brute([r[1] for r in rows])
    return sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n) for r, n in zip(rows, counts, strict=True))


TRICKY = [
    "it's they're we'll 'tis   spaced    out\n\n\nlines <|endoftext|> inside<|endoftext|><|endoftext|> 12345 --- ???",
    "漢字かな交じり文。" * 40, "aé" * 300, " " * 700, "<|endoftext|>" * 60, "x" * 900, "don't" * 150, "\n" * 333 + "a", "　   " * 90, "'re'" * 200,
]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 24), (100, 40), (257, 64)])
def test_spliced_counts_equal_whole_counts(spark, make, chunk, overlap):
    texts = [*TRICKY, prose(1, 900), *["".join(TRICKY[k:]) for k in range(4)]]
    rows = [(k, t) for k, t in enumerate(texts)]
    assert rows_of(tc.token_counts(make(rows), chunk=chunk, overlap=overlap)) == want(rows)


def test_overlaps_are_widened(spark, make):
    rows = [(1, "z" * 3000 + " end"), (2, "ab cd " * 400)]
    assert rows_of(tc.token_counts(make(rows), chunk=128, overlap=32)) == want(rows)


def test_odd_rows(odd, empty):
    assert rows_of(tc.token_counts(odd)) == want(odd_rows())
    assert rows_of(tc.token_counts(odd, chunk=1000, overlap=64)) == want(odd_rows())
    assert tc.token_counts(empty).count() == 0


def test_whole_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert rows_of(tc.token_counts(df)) == want(rows)
    assert rows_of(tc.token_counts(df, chunk=2000, overlap=128)) == want(rows)


def test_rank_file_and_tokenizer_agree_on_code_points():
    """Both encoders over every 7th code point, in the surroundings in which its class matters."""
    words, ranks = tc._json_encoder("byte_bpe_50k"), tc._rank_encoder("byte_bpe_50k")
    points = [c for c in [*range(0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    texts = [f"x{chr(c)}y {chr(c)}{chr(c)}1{chr(c)}  {chr(c)}'s" for c in points]
    got = words.encode_batch(texts, add_special_tokens=False)
    assert all(e.ids == ranks.encode(t, allowed_special="all") for e, t in zip(got, texts, strict=True))
