"""Archives to a store to searches, over HTTP and the tool endpoint."""

import io
import json
import random
import tarfile
import threading
import urllib.error
import urllib.request

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillsearch.embed.providers import Hashed, over
from quillsearch.operators import index
from quillsearch.operators.store import Engine
from quillsearch.service import cli, rpc
from quillsearch.service.app import App, Config
from quillsearch.service.web import server
from quillsearch.sources import archive, releases


def record(i, name, html, entity=None):
    r = {"identifier": i, "name": name, "article_body": {"html": html}}
    return json.dumps(r | ({"main_entity": {"identifier": entity}} if entity else {}))


def pack(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, text in members:
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store")
    one = [record(1, "Red fox", "<p>The quick red fox.</p><h2>Food</h2><p>It eats mice and berries.</p>", "Q1"), record(2, "Empty", ""), record(3, "Blue whale", "<p>A whale in the blue sea.</p>"), record(4, "No text", "<div>bare</div>")]
    two = [record(1, "Red Fox", "<p>The fox again, quick.</p>", "Q1b"), '{"broken', record(5, "Lost", "<p>lost</p>")]
    pack(folder / "a.tar.gz", [("m1.jsonl", "\n".join(one)), ("m2.jsonl", "\n".join(two)), ("m3.jsonl", record(6, "Green frog", "<p>The frog eats.</p>"))])
    made = Engine.open(spark, str(folder / "db"), True)
    made.ingest(str(folder / "a.tar.gz"))
    return made


def test_ingest(engine):
    got = {(r["id"], r["title"], r["entity"]) for r in engine.articles.collect()}
    assert got == {(1, "Red Fox", "Q1b"), (3, "Blue whale", ""), (6, "Green frog", "")}
    rows = sorted((r["article_id"], r["title"], r["content"]) for r in engine.sections.collect())
    assert rows == [(1, "", "The fox again, quick."), (1, "Food", "It eats mice and berries."), (3, "", "A whale in the blue sea."), (6, "", "The frog eats.")]
    assert engine.get("language") == b"en"
    with pytest.raises(KeyError):
        engine.get("none")


def test_searches(engine):
    assert [(r["article_id"], r["type"]) for r in engine.search_title("fox").collect()] == [(1, "T")]
    assert engine.search_title("fox").first()["snippet"] == "Red <mark>Fox</mark>"
    assert {r["article_id"] for r in engine.search_content("eats").collect()} == {1, 6}
    both = engine.search_lexical("fox").collect()
    assert [r["article_id"] for r in both] == [1] and both[0]["type"] == "T"
    assert both[0]["power"] > engine.search_title("fox").first()["power"]
    assert [r["text"] for r in engine.search_distance("wale", 1).collect()] == ["whale"]
    assert engine.search("nothing-here").count() == 0


def test_index_again_changes_nothing(engine):
    before = engine.search_lexical("eats").collect()
    engine.build_index()
    assert engine.search_lexical("eats").collect() == before


def test_article_and_compression(engine):
    a = engine.article(1)
    assert [s["title"] for s in a["sections"]] == ["Food", ""] or [s["title"] for s in a["sections"]] == ["", "Food"]
    engine.write("sections", engine.table("sections"))
    engine.compress()
    assert engine.article(1) == a
    with pytest.raises(LookupError):
        engine.article(99)


def test_vectors(engine):
    embed = Hashed(16)
    engine.sync_vectors(lambda rows: over(rows, embed), ann=True, ann_size=8)
    assert engine.table("vectors").count() == 4
    q = embed(["Blue whale -  A whale in the blue sea."])[0]
    hits = engine.search_semantic(q, 2).collect()
    assert hits[0]["article_id"] == 3 and hits[0]["type"] == "V"
    assert engine.search("whale", 5, q).first()["article_id"] == 3
    engine.sync_vectors(lambda rows: over(rows, embed))  # nothing is pending
    assert engine.table("vectors").count() == 4


def test_failed_batches_are_recorded(spark):
    def bad(texts):
        if "b" in texts:
            raise RuntimeError("no")
        return [[1.0]] * len(texts)

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, input string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["error"]) for r in over(rows, bad, batch=1).collect()}
    assert got == {1: ([1.0], None), 2: (None, "no")}


@pytest.fixture(scope="module")
def web(engine):
    http = server(App(engine, Config(web_port=0)))
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://localhost:{http.server_address[1]}"
    http.shutdown()


def get(url, body=None, **kw):
    request = urllib.request.Request(url, None if body is None else body.encode(), **kw)
    try:
        with urllib.request.urlopen(request) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_api(web):
    status, text = get(f"{web}/api/search?query=fox&limit=5")
    got = json.loads(text)
    assert status == 200 and got["status"] == "success" and got["results"][0]["article_id"] == 1 and "time" in got
    assert json.loads(get(f"{web}/api/search/title", '{"query": "whale", "limit": 0}')[1])["results"][0]["title"] == "Blue whale"
    assert json.loads(get(f"{web}/api/search?query=fox&limit=0")[1])["results"] == []
    assert get(f"{web}/api/search?query=fox&limit=-1")[0] == 500
    assert get(f"{web}/api/search?query=%20")[0] == 500
    assert get(f"{web}/api/search?limit=1")[0] == 400
    assert get(f"{web}/api/search?query=a&limit=x")[0] == 400
    assert get(f"{web}/api/search", "{bad")[0] == 400
    assert get(f"{web}/api/search/semantic?query=a")[0] == 400
    assert json.loads(get(f"{web}/api/search/distance?query=fix&limit=1")[1])["results"] == [{"text": "fox", "power": 1.0, "snippet": ""}]
    assert json.loads(get(f"{web}/api/article?id=1")[1])["article"]["title"] == "Red Fox"
    assert get(f"{web}/api/article?id=77")[0] == 500
    assert get(f"{web}/api/article")[0] == 400
    assert "<mark>" in get(f"{web}/?query=fox")[1] and "Red Fox" in get(f"{web}/article?id=1")[1]


def test_tools(web, engine):
    def ask(method, params=None):
        return json.loads(get(f"{web}/mcp", json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))[1] or "null")

    assert ask("initialize")["result"]["protocolVersion"] == "2024-11-05"
    assert {t["name"] for t in ask("tools/list")["result"]["tools"]} == {"search", "article"}
    assert ask("ping")["result"] == {} and ask("prompts/list")["result"] == {"prompts": []}
    assert ask("prompts/get")["error"]["code"] == -32602 and ask("none")["error"]["code"] == -32601
    assert ask("notifications/initialized") is None
    found = ask("tools/call", {"name": "search", "arguments": {"query": "whale"}})["result"]
    assert "**Blue whale** (Article ID: 3)" in found["content"][0]["text"] and not found["isError"]
    assert "# Red Fox" in ask("tools/call", {"name": "article", "arguments": {"id": 1}})["result"]["content"][0]["text"]
    app = App(engine)
    for name, args in (("search", {}), ("article", {}), ("article", {"id": "x"}), ("article", {"id": 99}), ("other", {})):
        assert rpc.call(app, name, args)["isError"]
    assert get(f"{web}/mcp", method="OPTIONS")[0] == 204 and get(f"{web}/mcp", method="DELETE")[0] == 200


def test_repl_and_flags(engine):
    said = []
    lines = iter(["whale", "1", ""])
    cli.repl(App(engine), lambda _: next(lines), said.append)
    assert said[0].endswith("Blue whale") and "A whale in the blue sea." in said
    config = cli.parse(["--limit", "3", "--web", "--db", "x"])
    assert (config.limit, config.web, config.db, config.web_port, config.ai_ann_size) == (3, True, "x", 35248, 64)


def test_read_only(spark, engine):
    with pytest.raises(PermissionError):
        Engine.open(spark, engine.path).put("a", "b")


def test_broken_lines(spark):
    rows = [("a", "m", 0, record(1, "x", "<p>x</p>")), ("a", "m", 1, "{bad"), ("a", "m", 2, record(2, "y", "<p>y</p>")), ("a", "n", 0, record(3, "z", "<p>z</p>"))]
    lines = archive.from_lines(spark.createDataFrame(rows, archive.LINES))
    assert {r["id"] for r in archive.articles(lines).collect()} == {1, 3}
    text = '{"a":1} {"b":2}\n[3] 12 {"long": "' + "x" * 50 + '"}{"c"'
    want = ['{"a":1}', '{"b":2}', "[3]", "12", text[text.index('{"long') : -4]]
    for size in (1, 2, 3, 7, 1000):
        assert list(archive.values(text[k : k + size] for k in range(0, len(text), size))) == want
    assert list(archive.values(text)) == want and list(archive.values("")) == [] and list(archive.values("12")) == ["12"]


def test_releases(spark, tmp_path):
    import gzip

    files = spark.createDataFrame([("en.db.gz",), ("de.db-2.gz",), ("de.db-1.gz",), ("x.txt",), ("a.db.gz.bak",)], "name string")
    assert [(r["base"], r["files"]) for r in releases.databases(files).collect()] == [("de", ["de.db-1.gz", "de.db-2.gz"]), ("en", ["en.db.gz"])]
    for k, text in enumerate((b"ab", b"cd")):
        (tmp_path / f"p{k}.gz").write_bytes(gzip.compress(text))
    assert releases.join_parts([str(tmp_path / "p1.gz"), str(tmp_path / "p0.gz")], str(tmp_path / "out")) == 4
    assert (tmp_path / "out").read_bytes() == b"abcd"


def test_phrases_are_counted(spark):
    """Phrases of several words, words that repeat in them, and lone words, against plain counting."""
    import random

    from quillsearch.operators import index, search

    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 14))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for phrases in ([["a", "b", "c"]], [["a", "a"], ["b"]], [["c", "a", "c", "a"], ["a", "b"], ["c"]]):
        want = {}
        for i, t in enumerate(texts):
            w = t.split()
            n = [sum(w[k : k + len(p)] == p for k in range(len(w))) for p in phrases]
            if any(x in w for p in phrases for x in p):
                want[i] = tuple(n)
        got = search.frequencies(index.postings(rows, "id", ["text"]), phrases).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_changes_appear_whole(spark, tmp_path):
    """Articles and sections are replaced by one manifest; what no manifest names goes."""
    made = Engine(spark, str(tmp_path / "db"))
    items = "array<struct<title:string,pow:int,content:string>>"
    page = lambda name: spark.createDataFrame([(1, name, "", [("", 0, name)], "a", "m", 0)], f"id long, title string, entity string, items {items}, archive string, member string, line long")
    made.put_articles(page("one"))
    before = Engine.open(spark, made.path)
    old = before.articles
    broken = made.folder.put
    made.folder.put = lambda name, data: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(OSError):
        made.put_articles(page("two"))
    made.folder.put = broken
    assert [r["title"] for r in made.articles.collect()] == ["one"] and made.sections.count() == 1
    made.put_articles(page("three"), {"batch": 7})
    assert [r["title"] for r in old.collect()] == ["one"]  # a reader keeps what it began with
    assert [r["title"] for r in before.articles.collect()] == ["three"] and made.mark("batch") == 7
    assert sorted(r["id"] for r in made.sections.collect()) == [1, 2]
    folders = len(made.folder.names())
    assert made.vacuum(1) == 1 and len(made.folder.names()) < folders
    assert made.sections.count() == 2 and made.vacuum(1) == 0
    with pytest.raises(FileExistsError):
        made.folder.put(made._manifests()[-1], b"")
    with pytest.raises(PermissionError):
        before.vacuum()


def test_store_and_archive_by_uri(spark, tmp_path):
    pack(tmp_path / "a.tar.gz", [("m", record(1, "Red fox", "<p>A fox.</p>"))])
    made = Engine.open(spark, f"file://{tmp_path}/db")
    made.ingest(f"file://{tmp_path}/a.tar.gz")
    assert [r["article_id"] for r in made.search_content("fox").collect()] == [1]
    assert not Engine.open(spark, f"file://{tmp_path}/db").writable


def test_streamed_lines_keep_their_order(spark, tmp_path):
    """The last line of a file wins, and a replayed batch changes nothing."""
    from quillsearch.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text("\n".join(record(1, f"Fox {k}", f"<p>fox {k}</p>") for k in range(300)) + "\n")
    made = Engine(spark, str(tmp_path / "db"))
    ingest.run(made, str(tmp_path / "in"), str(tmp_path / "ck"), reindex=False).awaitTermination()
    rows = sorted((r["id"], r["content"]) for r in made.sections.collect())
    assert rows == [(k + 1, f"fox {k}") for k in range(300)] and made.articles.first()["title"] == "Fox 299"
    (tmp_path / "ck2").mkdir()
    import shutil

    shutil.rmtree(tmp_path / "ck")  # the stream has forgotten the batch, the store has not
    ingest.run(made, str(tmp_path / "in"), str(tmp_path / "ck"), reindex=False).awaitTermination()
    assert made.sections.count() == 300


def test_streaming(spark, tmp_path):
    from quillsearch.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(record(1, "Fox", "<p>a fox</p>") + "\n")
    engine = Engine(spark, str(tmp_path / "db"))
    ingest.run(engine, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "in/b.jsonl").write_text(record(1, "Fox", "<p>a red fox</p>") + "\n")
    ingest.run(engine, str(tmp_path / "in"), str(tmp_path / "ck")).awaitTermination()
    assert [s["content"] for s in engine.article(1)["sections"]] == ["a red fox"]
    assert engine.search("red").first()["article_id"] == 1


def test_common_words_are_shared_out(spark, tmp_path):
    """A bucket has several tasks however many buckets there are, and rows of few postings."""
    made = Engine(spark, str(tmp_path / "db"))
    made.write("articles", spark.createDataFrame([(i, "ring", "") for i in range(0, 400, 2)], "id long, title string, entity string"))
    rows = [(i, i if i % 5 else None, "", "ring of ring", None, 0) for i in range(400)]
    made.write("sections", spark.createDataFrame(rows, "id long, article_id long, title string, content string, content_flate binary, pow int"))
    made.build_index(buckets=64)
    post = made.table("content_postings").where("term = 'ring'")
    assert len(post.inputFiles()) > 1 and post.select(F.input_file_name()).distinct().count() > 1
    assert post.agg(F.max(F.size("doc_id"))).first()[0] <= index.CHUNK
    got = {tuple(r) for r in index.unfolded(post.drop("bucket")).collect()}
    assert got == {(i, 3, i % 2 == 0 and i % 5 > 0, 1, p, "ring") for i in range(400) for p in (0, 2)}
    assert made.mark("corpus") == {"title": {"n_docs": 200, "n_tokens": 200}, "content": {"n_docs": 400, "n_tokens": 1200}}
    assert made.search_content("ring", 500).count() == 160


def test_postings_are_folded():
    """Against plain loops, in blocks of several sizes; an empty row is counted too."""
    rng = random.Random(5)
    rows = [(i, bool(i % 3), rng.choices("ab", k=rng.randint(0, 3)), rng.choices("abc", k=rng.choice([0, 2, 900]))) for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "owned": [r[1] for r in rows], "c0": [r[2] for r in rows], "c1": [r[3] for r in rows]})
    want = sorted((r[0], len(r[2]) + len(r[3]), r[1], c, p, t) for r in rows for c, ts in enumerate((r[2], r[3])) for p, t in [*([(-1, "")] if c == 0 else []), *enumerate(ts)])
    for most in (1, 1000, 10**9):
        cuts = list(index.blocks([1 + len(r[2]) + len(r[3]) for r in rows], most))
        assert [k for a, b in cuts for k in range(a, b)] == list(range(40)) and (most > 1 or len(cuts) == 40)
        got = [(d, x >> 33, bool(x >> 32 & 1), x >> 29 & 7, (x & (1 << 29) - 1) - 1, r["term"]) for a, b in cuts for r in index.folded(batch.slice(a, b - a)).to_pylist() for d, x in zip(r["doc_id"], r["told"], strict=True)]
        assert sorted(got) == want
