"""Every query and the pipeline on tables with null ids, null columns, repeated rows, very long texts, clashing columns and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from permulocus.llm import queries
from permulocus.llm.common import running

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
}
#: Names that operators use themselves, in columns of other types than theirs.
CLASHING = ("id", "n", "rows", "key", "label", "score", "kept", "blob", "spans", "digest", "word", "words", "part", "size", "line", "shard", "depth", "formatted", "turns", "fingerprint", "start", "length", "__id", "__s_base")
LONG = "many words and one token=abcdefgh here\n" * 3_000
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [None, "", " \n\t", "one", "Wörter, wörter\nA line of some length\n\nA line of some length", LONG, "x" * 100_000, PASSAGE, PASSAGE + " more"]
DOCUMENTS = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(TEXTS)]
DOCUMENTS += [DOCUMENTS[4], DOCUMENTS[7], DOCUMENTS[0], (None, "a text without id", "en", "s", 17), (None, "a text without id", "en", "s", 17), (None, None, None, None, None)]
TABLES = {
    "documents": DOCUMENTS,
    "labels": [(1, 1, 0), (1, 0, 1), (3, None, 1), (4, 1, None), (None, 1, 1), (5, 0, 0), (99, 1, 1)],
    "pages": [(i, None if i % 2 else f"http://a/{i}", t) for i, t in enumerate(TEXTS)] + [(4, "http://a/4", TEXTS[4]), (None, None, "<p>x</p>"), (None, "u", None)],
    "benchmark": [(0, PASSAGE), (1, None), (2, ""), (3, "one"), (3, "one"), (None, "a text")],
    "conversations": [(0, 0, "user", "hi"), (0, 0, "user", "hi"), (0, 1, "assistant", None), (1, None, None, "x"), (None, 0, "user", "y"), (2, 0, "user", LONG), (6, 0, "user", "hi")],
}
BY_DOCUMENT = [f"op{n}_" for n in (1, 6, 7, 8, 10, 11)]


def written(spark, path, tables, clashing=()):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(tables.get(name, []), schema)
        df = df.withColumns({c: F.array(F.lit(c)) for c in clashing if c not in df.columns})
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    return {
        "plain": written(spark, tmp_path_factory.mktemp("plain"), TABLES),
        "clashing": written(spark, tmp_path_factory.mktemp("clashing"), TABLES, CLASHING),
        "empty": written(spark, tmp_path_factory.mktemp("empty"), {}),
    }


def answer(spark, name, folder, columns=None):
    out = QUERIES[name](spark, folder)
    columns = columns or out.columns
    return columns, sorted(map(repr, map(tuple, out.select(*columns).collect())))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows_and_clashing_columns(spark, folders, name):
    columns, plain = answer(spark, name, folders["plain"])
    assert answer(spark, name, folders["clashing"], columns)[1] == plain
    if name.startswith(tuple(BY_DOCUMENT)):  # a row a row, whatever its id; equal rows get equal answers
        assert len(plain) == len(DOCUMENTS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    rows = answer(spark, name, folders["empty"])[1]
    assert len(rows) == (1 if name.startswith("op3_") else 0)  # op3 adds a conversation of its own


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 8, 9, 30])
def test_running_sums_over_blocks(spark, n):
    items = F.expr(f"slice(sequence(1, 40), 1, {n})")
    got = spark.range(1).select(running(items, lambda x: x * 2, lambda x, at: F.struct(x.alias("x"), at.alias("at")), "struct<x:int,at:bigint>", block=4).alias("r")).first().r
    assert [tuple(r) for r in got] == [(x, x * (x - 1)) for x in range(1, n + 1)]
