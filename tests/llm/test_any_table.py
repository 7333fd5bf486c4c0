"""What every operator and pipeline stage takes: nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import archive, decontaminate, edits, language, lines, packing, passages, secrets, simhash, topk

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHING = "_doc _text_hash _gone lines_left lines_removed _keep_id _copies _leak copies head group_id keep component node src dst line_hash site place shard tokens asked of salt _of _label _rate language cosine item_id start end id v key part trie f0 seed gone best".split()


def long_text(seed=1, n=120_000):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


LONG = long_text()
WORDY = " ".join(LONG.split()[:300])
ROWS = [
    (1, WORDY, "en", "a", 10), (2, WORDY + " tail", "en", "b", 10), (2, WORDY + " tail", "en", "b", 10), (3, None, "en", "a", None), (4, "", None, "a", 0), (5, "   \n \n", "de", None, 3),
    (None, WORDY, "en", "a", 10), (6, LONG, "en", "c", None), (7, '{"token": "q8Zr4Tn0Lx7Vw2Kp9Bd3Hm"}', None, None, None), (8, "!!! ???", "en", "a", 7), (9, "one line\nshared\n" + "zwei", "de", "d", 9),
    (9, "one line\nshared\n" + "zwei", "de", "d", 9), (10, "é ü 漢字 \U0001f600", "fr", "e", 6), (None, None, None, None, None),
]
ITEMS = [(1, " ".join(LONG.split()[100:130])), (1, " ".join(LONG.split()[100:130])), (2, None), (None, "a b c d e f"), (3, ""), (4, "too short")]


def benchmark(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('archives')}"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    benchmark(spark).write.parquet(f"{at}/benchmark.parquet")
    return at


OPERATORS = {
    "identify": lambda d, s, f: language.identify(d),
    "archives": lambda d, s, f: archive.write_archives(d, f).select("doc_id", "tokens", "checksum"),
    "lines": lambda d, s, f: lines.dedup_lines(d),
    "secrets": lambda d, s, f: secrets.scan(d),
    "near": lambda d, s, f: simhash.near_duplicates(d),
    "passages": lambda d, s, f: passages.repeated_passages(d),
    "edits": lambda d, s, f: edits.edited_counts(d),
    "edits of a table": lambda d, s, f: edits.edited_counts(d, d.sparkSession.createDataFrame([(1, 0, 4, "xy"), (None, 0, 1, "a"), (6, 5, None, "a"), (6, 100, 110, ""), (9, 500, 900, "z")], "doc_id bigint, start int, end int, replacement string")),
    "packing": lambda d, s, f: packing.pack_documents(d),
    "leaks": lambda d, s, f: decontaminate.find_leaks(d, benchmark(d.sparkSession)),
    **{name: (lambda d, s, f, fn=fn: fn(d.sparkSession, d, s)) for name, fn in corpus_pipeline.STAGES},
}
BASE = [c.split()[0] for c in SCHEMA.split(", ")]


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_clashing_names(spark, sf, folder, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    more = docs.select("*", *[F.lit("other").alias(c) for c in CLASHING])
    plain, clashing = OPERATORS[name](docs, sf, folder), OPERATORS[name](more, sf, folder)
    stages = [n for n, _ in corpus_pipeline.STAGES]
    if name in stages[:-1]:
        assert plain.columns == docs.columns and clashing.columns == more.columns
        assert clashing.filter("site = 'other' and key = 'other'").count() == plain.count()
    if name == "lines":
        # the names of its own columns are taken, so they get others
        assert plain.columns == BASE + ["lines_removed", "lines_left"] and len(clashing.columns) == len(more.columns) + 2
        assert rows_of(plain, plain.columns) == rows_of(clashing.toDF(*more.columns, "x", "y"), BASE + ["x", "y"])
    else:
        assert rows_of(plain, plain.columns) == rows_of(clashing, plain.columns)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, sf, folder, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = OPERATORS[name](empty, sf, folder)
    assert out.count() == 0
    assert out.columns == OPERATORS[name](spark.createDataFrame(ROWS[:2], SCHEMA), sf, folder).columns


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_only_nulls(spark, sf, folder, name):
    nothing = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (1, None, None, None, None)], SCHEMA)
    OPERATORS[name](nothing, sf, folder).collect()


def test_defined_results(spark, sf, folder):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    seen = {(r["doc_id"], r["keep"]) for r in language.identify(docs).collect()}
    assert {(3, False), (4, False), (5, False), (8, False), (None, False), (1, True), (10, True)} <= seen
    near = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    assert None not in near and near[2]["group_id"] == 1 and near[2]["copies"] == 2 and not near[2]["keep"] and near[3]["keep"] and near[4]["keep"]
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9, 10}
    assert simhash.keep_one(docs).filter("doc_id = 9").count() == 1
    mixed = spark.createDataFrame([(1, f"text number {i}", "en", "a", i) for i in range(20)], SCHEMA)
    kept = {tuple(r) for n in (1, 3, 7) for r in simhash.keep_one(mixed.repartition(n)).collect()}
    assert len(kept) == 1
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, benchmark(spark)).collect()}
    assert found == {(1, 1), (2, 1), (6, 1)}
    assert decontaminate.find_leaks(docs, benchmark(spark, [])).count() == 0
    assert {r["doc_id"] for r in passages.repeated_passages(docs).collect()} == {2, 6}
    assert {r["doc_id"] for r in packing.pack_documents(docs).collect()} == {1, 2, 5, 6, 7, 8, 9, 10}
    assert [r["doc_id"] for r in secrets.scan(docs).collect()] == [7]
    index = archive.write_archives(docs, folder)
    assert index.count() == len(ROWS) and index.filter("tokens = 0").count() == 3


def test_topk_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int, id string, v string, at string, part string, d string"
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, None, 1), (None, [1.0, 1.0], 1), (5, [1.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [], 1), (9, [-1.0, 0.0], None)]
    rows += [(10, [1.0, inf], 1), (11, [-inf, 0.0], 1), (12, [2.0], 1), (13, [3.0], 1)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], schema)
    got = [tuple(r) for r in topk.top_k(df, k=2, every=1).orderBy("query_id", "rank").collect()]
    assert got == [
        (1, 1, 2, 1.0), (1, 2, 3, 0.0), (2, 1, 1, 1.0), (2, 2, 3, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0), (5, 1, 13, 3.0), (5, 2, 12, 2.0), (9, 1, 3, 0.0), (9, 2, 1, -1.0),
        (12, 1, 13, 6.0), (12, 2, 5, 2.0), (13, 1, 12, 6.0), (13, 2, 5, 3.0),
    ]
    assert {r["query_id"] for r in topk.top_k(df, k=2, every=3).collect()} == {3, 9, 12}
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id = 1"), every=1).count() == 0
