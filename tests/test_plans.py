"""The physical plans keep what makes them scale."""

import pytest
from pyspark.sql import functions as F

from quillsearch.operators import ivf, search, store
from quillsearch.plans import fixtures
from quillsearch.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = store.Engine.open(spark, str(tmp_path_factory.mktemp("plans") / "db"), True)
    made.write("articles", fixtures.articles(spark, SF))
    made.write("sections", fixtures.sections(spark, SF).select("id", "article_id", "title", "content", F.lit(None).cast("binary").alias("content_flate"), F.lit(0).alias("pow")))
    made.build_index()
    made.write("vectors", fixtures.vectors(spark, SF))
    made.build_ann(16, 50)
    return made


def test_postings_are_pruned(engine):
    text = plan(engine.content_index("thing erst").scores("thing erst"))
    assert "PartitionFilters: [bucket" in text.replace("isnotnull(bucket#", "bucket#") or "bucket#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(term" in text
    assert "content" not in text.split("ReadSchema:")[1].split("\n")[0]


def test_one_scan_of_postings(engine):
    """Statistics and scores share the shuffled postings of the query."""
    found = search.top(engine.content_index("thing erst").scores("thing erst", owned=True), 10)
    found.collect()
    text = plan(found).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text and text.count("term#") and text.count("ReadSchema: struct<doc_id") == 1
    assert "lengths" not in text and "SortMergeJoin" not in text


def test_rows_are_fetched_by_literals(engine):
    hits = search.settled(search.top(engine.content_index("thing").scores("thing"), 5), 5)
    text = plan(search.picked(engine.table("sections"), "id", hits, "doc_id", 5))
    assert "PushedFilters: [In(id" in text or "PushedFilters: [Or" in text or "id IN" in text


def test_only_hits_are_inflated(engine, spark):
    """The inflating function stands above the join with the hits, in every search."""
    hits = spark.createDataFrame([(1, -1.0)], "doc_id long, score double")
    sections = engine.table("sections")
    raw = search.Index(sections, "id", ["title", "content"])
    raw.scores = lambda query, owned=False: hits
    titles = search.Index(engine.articles, "id", ["title"])
    titles.scores = lambda query, owned=False: hits
    for df in (search.contents(raw, engine.articles, "thing", 5), search.titles(titles, sections, "small", 5), engine.search_semantic([0.1] * 64, 5)):
        lines = plan(df).split("\n")
        at = next(k for k, line in enumerate(lines) if "ArrowEvalPython" in line and "inflate" in line)
        joins = [k for k, line in enumerate(lines) if "Join" in line and k > at]
        scan = next(k for k, line in enumerate(lines) if "content_flate" in line and "FileScan" in line)
        assert joins and min(joins) < scan


def test_top_k_is_not_a_sort(engine):
    assert "TakeOrderedAndProject" in plan(search.top(engine.content_index("thing").scores("thing"), 10))
    assert "TakeOrderedAndProject" in plan(ivf.similar(engine.table("vectors"), [0.1] * 64, 10))


def test_cells_are_pruned(engine, spark):
    q = engine.table("vectors").first()["embedding"][:16]
    text = plan(ivf.search(engine.table("ann"), engine.table("centroids"), q, 1, 50, 1))
    assert "bucket#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "centroid_id,[" in text or "centroid_id#" in text.split("DataFilters: [")[1].split("]")[0]


def test_semantic_reads_only_hits(engine):
    text = plan(engine.search_semantic([0.1] * 64, 5))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_stored_and_raw_agree(engine, spark):
    raw = search.contents(search.Index(fixtures.sections(spark, SF), "id", ["title", "content"]), fixtures.articles(spark, SF), "thing erst", 10)
    assert [tuple(r) for r in engine.search_content("thing erst", 10).collect()] == [tuple(r) for r in search.plain(raw).collect()]
    both = engine.search("red", 10, engine.table("vectors").first()["embedding"]).collect()
    assert both and all(0 <= r["power"] <= 100 for r in both)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) > 40
