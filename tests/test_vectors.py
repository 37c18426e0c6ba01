import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillsearch.functions import vectors as V
from quillsearch.operators import fusion, ivf


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, embedding array<float>")


def test_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(V.dot(F.col("a"), F.col("b")).alias("d"), V.unit(F.col("a")).alias("u"), V.euclidean(F.col("a"), F.col("b")).alias("e"), V.from_bytes(V.to_bytes("a")).alias("c")).collect()
    assert [r["d"] for r in rows] == [11.0, 0.0]
    assert [r["u"] for r in rows] == [[0.6, 0.8], [0.0, 0.0]]
    assert abs(rows[0]["e"] - 8**0.5) < 1e-9 and rows[0]["c"] == [3.0, 4.0]
    bits = spark.createDataFrame([([0b1010, 1], [0b0110, 0])], "a array<int>, b array<int>")
    assert bits.select(V.hamming(F.col("a"), F.col("b"))).first()[0] == 3


@pytest.mark.parametrize("f", [V.dot, V.euclidean, V.hamming])
def test_lengths_must_match(spark, f):
    kind = "int" if f is V.hamming else "float"
    df = spark.createDataFrame([([1], [1, 2])] if f is V.hamming else [([1.0], [1.0, 2.0])], f"a array<{kind}>, b array<{kind}>")
    with pytest.raises(PySparkException):
        df.select(f(F.col("a"), F.col("b"))).collect()
    with pytest.raises(PySparkException):
        df.select(V.truncate(F.col("a"), 2)).collect()


def golden(x, cell, rounds=10):
    n, k = len(x), max(1, len(x) // cell)
    c = x[[i * n // k for i in range(k)]].copy()
    for _ in range(rounds):
        who = (x @ c.T).argmax(axis=1)
        now = np.zeros_like(c)
        for i in range(k):
            now[i] = x[who == i].sum(axis=0) if (who == i).any() else x[7 * i % n]
        c = ivf.unit_rows(now)
    return who + 1, c


def test_kmeans(spark):
    rng = np.random.default_rng(1)
    x = ivf.unit_rows(rng.standard_normal((203, 6)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    centroids, cells = ivf.kmeans(df, 40)
    want, c = golden(x, 40)
    got = dict(cells.select("id", "centroid_id").collect())
    assert [got[i] for i in range(len(x))] == want.tolist()
    assert np.allclose(centroids, c)
    slots = ivf.layout(cells, 7).collect()
    assert sorted(r["section_id"] for r in slots) == list(range(203)) and max(r["pos"] for r in slots) <= 6
    assert sorted({r["chunk_id"] for r in slots}) == list(range(1, 1 + len({r["chunk_id"] for r in slots})))


def test_kmeans_with_empty_cells(spark):
    x = np.array([[1.0, 0.0]] * 6 + [[0.0, 1.0]] * 2)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    _, cells = ivf.kmeans(df, 2)
    got = dict(cells.select("id", "centroid_id").collect())
    assert [got[i] for i in range(8)] == golden(x, 2)[0].tolist()


def test_full_probe_equals_scan(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 8))
    vectors = table(spark, x)
    short = ivf.truncated(vectors, 4)
    centroids, cells = ivf.kmeans(short, 30)
    ann = ivf.layout(cells, 30)
    c = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(centroids)], "id int, centroid array<double>")
    q = ivf.unit_rows(x[:1, :4])[0]
    every = [r["id"] for r in ivf.search(ann, c, q, 10, 30, 50).collect()]
    assert every == [r["id"] for r in ivf.similar(short, q, 10).collect()]
    none = spark.createDataFrame([], "id int, centroid array<double>")
    assert every == [r["id"] for r in ivf.search(ann, none, q, 10).collect()]


def test_semantic_modes(spark):
    x = np.eye(4)
    sections = spark.createDataFrame([(0, 1, "a", "text"), (1, 9, "b", "orphan")], "id long, article_id long, title string, content string")
    articles = spark.createDataFrame([(1, "One")], "id long, title string")
    hits = ivf.semantic(sections, articles, [1.0, 0, 0, 0], 3, table(spark, x)).collect()
    assert [(r["article_id"], r["title"], r["power"]) for r in hits] == [(1, "One", 100.0), (0, "", 50.0), (0, "", 50.0)]
    assert ivf.semantic(sections, articles, [1.0], 3).count() == 0
    with pytest.raises(ValueError):
        ivf.semantic(sections, articles, [1.0], -1)


def results(spark, rows):
    return spark.createDataFrame([(a, "", "", t, p, "", (s, r)) for a, t, p, s, r in rows], "article_id long, title string, text string, type string, power double, snippet string, ord struct<stage:int,rank:int>")


def test_fusion(spark):
    rows = results(spark, [(1, "T", 50.0, 0, 1), (2, "T", 100.0, 0, 2), (1, "C", 50.0, 1, 1), (3, "C", 0.0, 1, 2), (2, "C", 30.0, 1, 3)])
    got = [(r["article_id"], r["type"], r["power"]) for r in fusion.fuse(rows, 10).collect()]
    assert got == [(2, "T", 100.0), (1, "T", 75.0), (3, "C", 0.0)]
    assert [r["article_id"] for r in fusion.fuse(rows, 1).collect()] == [2]
    assert fusion.fuse(rows, 0).count() == 0


def test_fusion_cuts_between_stages(spark):
    kept = fusion.fuse(results(spark, [(1, "T", 60.0, 0, 1), (2, "T", 50.0, 0, 2)]), 1)
    more = results(spark, [(2, "V", 50.0, 0, 1)]).withColumn("score", F.lit(-1.0)).withColumn("hit", F.lit(5))
    got = [(r["article_id"], r["power"]) for r in fusion.refuse(kept, more, 2).collect()]
    assert got == [(1, 60.0), (2, 50.0)]  # not 75: article 2 was cut before


def test_nearest_is_bounded():
    """As one product gives it, with the lowest of equal cells; memory doesn't follow the cells."""
    import tracemalloc

    rng = np.random.default_rng(4)
    c = rng.standard_normal((4000, 4))
    c[3000:] = c[:1000]
    x = rng.standard_normal((5000, 4))
    tracemalloc.start()
    got = ivf.nearest(x, c, 1 << 16)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5e6  # all at once they are 160 MB
    assert got.tolist() == (x @ c.T).argmax(axis=1).tolist() and got.max() < 3000
    assert ivf.nearest(x[:3], c, 1).tolist() == got[:3].tolist() and len(ivf.nearest(x[:0], c)) == 0
