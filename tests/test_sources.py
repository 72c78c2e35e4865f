"""Readers and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from pairwright.sinks import writers
from pairwright.sources import blocks, dimensions, readers

PLAIN = """“The drone controller must always prevent collisions”
<<DroneController>> G(no_collision)

# remark
<<x>> G(orphan)
A user must not access a resource until authentication succeeds.
⟨⟨system⟩⟩ G (¬authentication → ¬access)
❌ A bad one
<<y>> G(z)
Interpreting as a strict rule
<<y>> G(w)
"""
QUOTED = '"First one"\n<<a>> G p\n"no formula"\n"Second one"\n<<b>> F q\n'
SAME_LINE = '"First one" -> <<a>> G p\n"Second one" -> <<b>> (p U\nq)\n\n"Third" -> <<c>> X r'


@pytest.fixture
def folder(tmp_path):
    for name, text in [("a.txt", PLAIN), ("b.txt", QUOTED), ("c.txt", SAME_LINE), ("d.txt", QUOTED)]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    (tmp_path / "skip.md").write_text("no", encoding="utf-8")
    return str(tmp_path)


def test_formats(spark, folder):
    files = blocks.read_texts(spark, folder)
    got = {r.file: r.f for r in files.select("file", blocks.text_format(F.col("text")).alias("f")).collect()}
    assert got == {"a.txt": 3, "b.txt": 1, "c.txt": 2, "d.txt": 1}


def test_parse(spark, folder):
    rows = blocks.parse_texts(blocks.read_texts(spark, folder)).orderBy("file", "pos").collect()
    assert [(r.file, r.nl, r.formula) for r in rows] == [
        ("a.txt", "“The drone controller must always prevent collisions”", "<<DroneController>> G(no_collision)"),
        ("a.txt", "A user must not access a resource until authentication succeeds.", "⟨⟨system⟩⟩ G (¬authentication → ¬access)"),
        ("b.txt", "First one", "<<a>> G p"),
        ("b.txt", "Second one", "<<b>> F q"),
        ("c.txt", "First one", "<<a>> G p"),
        ("c.txt", "Second one", "<<b>> (p U\nq)"),
        ("c.txt", "Third", "<<c>> X r"),
        ("d.txt", "First one", "<<a>> G p"),
        ("d.txt", "Second one", "<<b>> F q"),
    ]
    bare = blocks.parse_texts(blocks.read_texts(spark, folder), strip_quotes=True).filter("file = 'a.txt'").orderBy("pos").first()
    assert bare.nl == "The drone controller must always prevent collisions"


def test_load_counts_and_store(spark, folder):
    store, counts = blocks.load_texts(blocks.read_texts(spark, folder))
    assert {r.file: (r.added, r.duplicates) for r in counts.collect()} == {
        "a.txt": (2, 0), "b.txt": (2, 0), "c.txt": (2, 1), "d.txt": (0, 2),
    }
    rows = store.collect()
    assert len(rows) == 6 and len({r.id for r in rows}) == 6
    one = next(r for r in rows if r.agents == ["system"])
    assert one.atl_formula == "<<system>> G (!authentication -> !access)" and one.domain == "access_control"


@pytest.mark.parametrize("chunk", [1, 2, 3, 100])
def test_line_table_equals_texts(spark, folder, chunk):
    files = blocks.read_texts(spark, folder).filter("file = 'a.txt'")
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    got = blocks.pair_line_table(lines, ["file"], "pos", "line", chunk).orderBy("pos").collect()
    want = files.select(F.explode(blocks.plain_pairs(F.col("text"))).alias("p")).select("p.*").collect()
    assert [(r.nl, r.formula) for r in got] == [(r.nl, r.formula) for r in want]


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(
        '{"id": "1", "nl_statement": "x", "atl_formula": "f", "agents": ["a"]}\n\n   \n'
        '{"id": "2", "nl": "y", "atl": "g", "source": "s", "unknown": 1}\n', encoding="utf-8"
    )
    (tmp_path / "b.jsonl").write_text('{"id": "3", "nl_text": "z"}\n{"id": \n', encoding="utf-8")
    (tmp_path / "c.json").write_text(json.dumps({"version": "1.0", "samples": [{"id": "4"}, {"id": "5"}], "stats": {}}, indent=1), encoding="utf-8")
    (tmp_path / "d.json").write_text(json.dumps([{"id": "6"}, {"id": "7"}], indent=1), encoding="utf-8")
    (tmp_path / "e.json").write_text(json.dumps({"pairs": [{"id": "8"}]}), encoding="utf-8")
    (tmp_path / "f.json").write_text(json.dumps({"other": 1}), encoding="utf-8")
    p = lambda n: str(tmp_path / n)
    a = readers.read_jsonl(spark, p("a.jsonl")).orderBy("id").collect()
    assert [(r.nl_statement, r.atl_formula, r.source_file, r.domain) for r in a] == [("x", "f", None, "generic"), ("y", "g", "s", "generic")]
    with pytest.raises(Exception):
        readers.read_jsonl(spark, p("b.jsonl")).collect()
    good, bad = readers.read_jsonl_lenient(spark, p("b.jsonl"))
    assert [r.nl_statement for r in good.collect()] == ["z"]
    assert [(r.file, r.line.strip()) for r in bad.collect()] == [("b.jsonl", '{"id":')]
    every = readers.read_samples(spark, [p("a.jsonl"), p("b.jsonl"), p("c.json"), p("d.json"), p("e.json")])
    assert sorted(r.id for r in every.collect()) == list("12345678")
    with pytest.raises(Exception):
        readers.read_json_document(spark, p("f.json")).collect()
    with pytest.raises(ValueError):
        readers.read_samples(spark, [p("x.csv")])
    with pytest.raises(Exception):
        readers.read_samples(spark, [p("missing.jsonl")])


def test_domains(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"domains": {"a": {"agents": ["x"], "atoms": {"p": "p holds"}}, "b": {"agents": [], "atoms": {}}}}))
    (tmp_path / "u.json").write_text(json.dumps({"test_domains": {"b": {"agents": ["y", "z"], "atoms": {}}, "c": {"agents": ["w"], "atoms": {}}}}))
    base = dimensions.read_domains(spark, str(tmp_path / "t.json"))
    over = dimensions.read_domains(spark, str(tmp_path / "u.json"), "test_domains")
    merged = dimensions.merged_domains(base, over)
    assert {r.domain: r.agents for r in merged.collect()} == {"a": ["x"], "b": ["y", "z"], "c": ["w"]}
    assert [(r.domain, r.atom, r.phrase) for r in dimensions.domain_atoms(merged).collect()] == [("a", "p", "p holds")]
    assert [r.domain for r in dimensions.shared_domains(base, over).collect()] == ["b"]


def test_shapes(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"templates": [{"id": "a", "category": "c", "atl_template": "<<{coalition}>> G {p}", "nl_templates": ["{p_nl}"]}]}))
    assert dimensions.read_shapes(spark, str(tmp_path / "t.json")).first()["nl_templates"] == ["{p_nl}"]


def test_unknown_sink_format(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_dataset(spark.range(1), str(tmp_path / "x"), "yaml")


def test_nulls_left_out(spark, tmp_path):
    df = spark.sql("SELECT 'a' AS id, CAST(NULL AS STRING) AS domain, 'é ⟨⟨' AS nl")
    writers.write_jsonl(df, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == '{"id":"a","nl":"é ⟨⟨"}'


def test_comparison_map(spark, tmp_path):
    row = {
        "sample_id": "s1", "nl_statement": "x",
        "translations": {"base": {"atl_formula": "f", "response_time": 1.23456, "tokens_used": 3}, "third": {"error": "404"}},
        "review": {"base_correct": True, "third_correct": None, "notes": ""},
    }
    (tmp_path / "r.json").write_text(json.dumps([row]))
    from pairwright import schemas

    raw = spark.read.schema(schemas.REVIEW).option("multiLine", True).json(str(tmp_path / "r.json"))
    got = {r.model: (r.correct, r.error) for r in readers.reviews_long(raw).collect()}
    assert got == {"base": (True, None), "third": (None, "404")}


@pytest.mark.parametrize("split", ["40", "1000", "128m"])
def test_lines_of_split_files(spark, tmp_path, split):
    texts = {f"f{k}.txt": "".join(f"line {i} of {k} {'x' * (i * 7 % 30)}\n" for i in range(k * 40)) for k in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = blocks.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    want = {(name, i, line) for name, text in texts.items() for i, line in enumerate(text.splitlines())}
    assert {(r.file.rsplit("/", 1)[1], r.pos, r.line) for r in got} == want and len(got) == len(want)


def test_a_file_that_is_no_text_is_told_and_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Say p.\n<<a>> G p\nSay p.\n<<a>> G p\n")
    (tmp_path / "b.txt").write_bytes(b"Say q.\n<<a>> G q\n\xff\xfe\n")
    (tmp_path / "c.txt").write_text("nothing here\n")
    (tmp_path / "d.txt").write_text("Say p.\n<<a>> G p\nSay r.\n<<a>> F r\n")
    (tmp_path / "e.txt").write_text("")
    store, report = blocks.load_folder(spark, str(tmp_path))
    assert sorted(tuple(r) for r in report.collect()) == [
        ("a.txt", "loaded", 1, 1), ("b.txt", "undecodable", 0, 0), ("c.txt", "no_pairs", 0, 0), ("d.txt", "loaded", 1, 1),
    ]
    assert {(r.nl_statement, r.source_file) for r in store.collect()} == {("Say p.", "a.txt"), ("Say r.", "d.txt")}


def test_statistics_of_routed_rows(spark, tmp_path):
    from decimal import Decimal

    rows = [(s, Decimal(k), "ab" * k) for k, s in enumerate(["verified", "rejected", "verified", None, "odd", "rejected"])]
    df = spark.createDataFrame([(s, None if k == 2 else k, t) for s, k, t in rows], "verification_status string, c decimal(9,2), t string")
    writers.write_routed(df.repartition(4), f"{tmp_path}/rows", stats=f"{tmp_path}/stats", measures={"c": F.col("c")})
    got = {r.route: (r.n, r.c_sum, r.c_count) for r in spark.read.schema("route string, n long, c_sum double, c_count long").json(f"{tmp_path}/stats").collect()}
    assert got == {"verified": (2, 0.0, 1), "rejected": (2, 6.0, 2), "needs_review": (0, None, 0), None: (2, 7.0, 2)}
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 6
