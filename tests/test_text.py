"""Tokens, phrases, scores and snippets against SQLite's full-text search."""

import random
import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsearch.functions import text as X
from quillsearch.operators import index, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def fts(spark):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE s USING fts5(title, content)")
    db.executemany("INSERT INTO s(rowid, title, content) VALUES (?, ?, ?)", rows)
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(s, row)")
    return db, {r[0]: r[2] for r in rows}


def sections(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d.select(F.col("doc_id").alias("id"), F.expr("doc_id DIV 8").alias("article_id"), F.col("lang").alias("title"), F.col("text").alias("content"))


def test_vocabulary(spark, fts):
    ours = {tuple(r) for r in index.term_rows(index.postings(sections(spark), "id", ["title", "content"])).collect()}
    assert ours == set(fts[0].execute("SELECT term, doc, cnt FROM v").fetchall())


@pytest.mark.parametrize("query", ["thing", "thing erst", "thing thing", "the", "of-the", "the of-the", "le-de", "zzz", "thing !!", "éeaux"])
def test_scores(spark, fts, query):
    want = dict(fts[0].execute("SELECT rowid, bm25(s) FROM s WHERE s MATCH ?", [X.quoted(query)]).fetchall())
    got = {r["doc_id"]: r["score"] for r in search.Index(sections(spark), "id", ["title", "content"]).scores(query).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_punctuation_alone_matches_nothing(spark):
    assert search.Index(sections(spark), "id", ["title", "content"]).scores("!!! ...").count() == 0


def test_snippets(fts):
    db, texts = fts
    words = sorted({w for t in texts.values() for w, _, _ in X.spans(t)[:50]})
    rng = random.Random(5)
    seen = 0
    for _ in range(60):
        query = " ".join(rng.sample(words, rng.choice((1, 1, 2))))
        for n in (16, 64):
            for row, want in db.execute(f"SELECT rowid, snippet(s, 1, '<mark>', '</mark>', '...', {n}) FROM s WHERE s MATCH ?", [X.quoted(query)]).fetchall():
                assert X.snippet(texts[row], X.phrases(query), n) == want
                seen += 1
    assert seen > 100


def test_tokens_of_odd_texts(spark):
    texts = ["don't C++ foo_bar", "Éñİ ß ø", "ệ", "éa x", "中文 字", "a1b2 ½", "", "x", "ǲ K"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(x)")
    db.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", list(enumerate(texts)))
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, instance)")
    want = {i: [] for i in range(len(texts))}
    for term, doc, _, off in sorted(db.execute("SELECT term, doc, col, offset FROM v"), key=lambda r: (r[1], r[3])):
        want[doc].append(term)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", X.tokens(F.col("x")).alias("t")).collect()
    for r in got:
        assert r["t"] == want[r["i"]], texts[r["i"]]
        assert [w for w, _, _ in X.spans(texts[r["i"]])] == want[r["i"]]


def test_small_functions(spark):
    df = spark.createDataFrame([("a　 b", "h2", "x" * 161), ("", None, None), ("  t ", "99999999999999999999", "y")], "a string, h string, c string")
    rows = df.select(X.fields(F.col("a")).alias("f"), X.trim(F.col("a")).alias("t"), X.first_number(F.col("h")).alias("n"), X.preview(F.col("c")).alias("p")).collect()
    assert [r["f"] for r in rows] == [["a", "b"], [], ["t"]]
    assert [r["t"] for r in rows] == ["a　 b", "", "t"]
    assert [r["n"] for r in rows] == [2, 0, 0]
    assert [r["p"] for r in rows] == ["x" * 160 + "...", None, "y"]
    assert X.quoted('a "b" ') == '"a" """b"""'
    assert X.quoted("  ") == ""


def test_deflate(spark):
    df = spark.createDataFrame([("héllo " * 50,), ("",), (None,)], "c string")
    rows = df.select("c", X.deflate("c").alias("z")).select("c", X.inflate("z").alias("b"), "z").collect()
    assert [r["b"] for r in rows] == [r["c"] for r in rows]
    assert len(rows[0]["z"]) < 60 and rows[1]["z"] == b""


@given(st.text(), st.text())
def test_snippet_never_fails(text, query):
    out = X.snippet(text, X.phrases(query), 4)
    assert isinstance(out, str)


def test_nearest_words(spark):
    words = spark.createDataFrame([("kitten",), ("sitting",), ("kitten",), ("mitten",), ("é",)], "term string")
    got = [(r["text"], r["power"]) for r in search.nearest_words(words, "kitten", 3).collect()]
    assert got == [("kitten", 0.0), ("mitten", 1.0), ("sitting", 3.0)]
    assert [r["power"] for r in search.nearest_words(words, "", 9).collect()] == [1.0, 6.0, 6.0, 7.0]
    assert search.nearest_words(words, "x", 0).count() == 0
    with pytest.raises(ValueError):
        search.nearest_words(words, "x", -1)


def test_functions_in_python_give_small_arrays():
    """What is made of a batch is in hand a slice at a time, with every row answered in its place."""
    import pyarrow as pa

    seen = []

    def one(v):
        seen.append(v)
        return None if v is None else v * 10

    batch = pa.array(["a" * 900, None, "", "b" * 5000, *["c" * 300] * 20])
    out = X.sliced(iter([batch, pa.array([], pa.string()), pa.array(["z"])]), one, pa.string(), 2000)
    first = next(out)
    assert len(seen) == len(first) < 5  # nothing beyond the first slice was made
    rest = list(out)
    assert [v for a in (first, *rest) for v in a.to_pylist()] == [None if v is None else v * 10 for v in [*batch.to_pylist(), "z"]]
    assert max(len(a) for a in rest) <= 6
    assert [len(a) for a in X.sliced(iter([pa.array(["ab"] * 6)]), len, pa.int64(), 200, times=50)] == [1] * 6
