from pyspark.sql import functions as F

from quillsearch.functions import html as H
from quillsearch.functions.html import external, parse, sections


def one(html):
    return [(s["title"], s["pow"], s["content"]) for s in sections(html)]


def test_headings_and_paragraphs():
    assert one("<p>intro</p><h2>A</h2><p>x<p>y<h3>B</h3><p>z") == [("", 0, "intro"), ("A", 2, "x\n\ny"), ("B", 3, "z")]


def test_repeated_heading_merges_and_keeps_first_level():
    assert one("<h2>A</h2><p>x</p><h3>B</h3><p>y</p><h4>A</h4><p>z</p>") == [("A", 2, "x\n\nz"), ("B", 3, "y")]


def test_paragraph_equal_to_heading_is_dropped():
    assert one("<h2>A</h2><p>A</p><p>b</p>") == [("A", 2, "b")]
    assert one("<h2>A</h2><p>A</p>") == []


def test_skipped_elements():
    html = "<p>a<style>s</style><script>var t='</p>';</script><math>m</math><sup class='reference'>1</sup><sup>2</sup></p><table><tr><td><p>t</p></td></tr></table>"
    assert one(html) == [("", 0, "a2")]


def test_lists():
    assert one("<ul><li>a<li>b<ul><li>c</li></ul></li></ul>") == [("", 0, "• a\n• b\t• c")]
    assert one("<ol><li> </li><li>x</li></ol>") == [("", 0, "•  \n• x")]


def test_external_items_are_left_to_the_walk():
    html = "<ul><li>keep</li><li><a class='x external'>out</a><p>inner</p><ul><li>deep</li></ul></li></ul>"
    assert one(html) == [("", 0, "• keep\n\ninner\n\n• deep")]
    assert external(parse(html)) and not external(parse("<a class='internal'>x</a>"))


def test_reference_lists_are_kept():
    assert one("<ol class='references'><li>ref</li></ol>") == [("", 0, "• ref")]


def test_bare_text_and_nothing():
    assert one("<div>bare</div>") == []
    assert one("") == [] and sections(None) == []
    assert one("<blockquote><p>q</p></blockquote>") == [("", 0, "q")]


def test_deep_nesting():
    assert one("<div>" * 5000 + "<p>x</p>") == [("", 0, "x")]


def test_pages_are_parsed_once(spark, tmp_path):
    """Filters on sections, and the one that exploding implies, stand above the one evaluation."""
    pages = spark.createDataFrame([(1, "<p>a</p><h2>T</h2><p>b</p>"), (2, ""), (3, None)], "id long, html string")
    items = pages.select("id", H.sectioned("html").alias("items")).where(F.size("items") > 0)
    out = items.select("id", F.posexplode("items").alias("place", "item")).select("id", "place", "item.*")
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1
    assert [tuple(r) for r in out.orderBy("place").collect()] == [(1, 0, "", 0, "a"), (1, 1, "T", 2, "b")]
