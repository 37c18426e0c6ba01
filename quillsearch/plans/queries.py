"""Every registered query of the engine, with its SQL oracle beside it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import vectors as V
from ..functions.folds import MARKS, SOURCE, TARGET
from ..operators import fusion, index, ivf, search, store
from ..sources import archive, releases
from .fixtures import articles, sections, table, vector, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CONTENT_QUERY, TITLE_QUERY, PHRASE_QUERY, BOTH_QUERY = "thing erst", "small ring", "the-of", "red"
LIMIT, CELL, FLOOR, PROBE_LIMIT, SHORT = 10, 50, 2, 2, 16


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# SQL fragments ------------------------------------------------------------------------


def toks(column: str) -> str:
    return f"regexp_extract_all(lower(translate(coalesce({column}, ''), '{SOURCE + MARKS}', '{TARGET}')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


def sql_scores(name: str, source: str, key: str, columns: list[str], text: str) -> str:
    """CTEs ending in ``{name}``(doc_id, score) for the rows that have all phrases."""
    wanted = X.phrases(text)
    distinct = list(dict.fromkeys(map(tuple, wanted)))

    def count(c: str, p: tuple[str, ...]) -> str:
        test = " AND ".join(f"{c}[i + {k}] = '{t}'" for k, t in enumerate(p))
        return f"len(list_filter(range(1, len({c}) + 1), lambda i: coalesce({test}, false)))"

    cols = ", ".join(f"{toks(c)} AS c{i}" for i, c in enumerate(columns))
    fs = ", ".join(" + ".join(count(f"c{i}", p) for i in range(len(columns))) + f" AS f{k}" for k, p in enumerate(distinct))
    length = " + ".join(f"len(c{i})" for i in range(len(columns)))
    ns = ", ".join(f"count(*) FILTER (f{k} > 0) AS n{k}" for k in range(len(distinct)))
    terms = []
    for k, p in enumerate(distinct):
        idf = f"CASE WHEN ln((n - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{k} + 0.5) / (n{k} + 0.5)) END"
        terms.append(f"{sum(tuple(q) == p for q in wanted)} * ({idf}) * f{k} * 2.2e0 / (f{k} + 1.2e0 * (0.25e0 + 0.75e0 * l / (t / n)))")
    every = " AND ".join(f"f{k} > 0" for k in range(len(distinct)))
    return f"""{name}_t AS MATERIALIZED (SELECT {key} AS doc_id, {cols} FROM {source}),
{name}_f AS MATERIALIZED (SELECT doc_id, {length} AS l, {fs} FROM {name}_t),
{name}_s AS (SELECT count(*)::DOUBLE AS n, sum(l)::DOUBLE AS t, {ns} FROM {name}_f),
{name} AS MATERIALIZED (SELECT doc_id, round(-({" + ".join(terms)}), 6) AS score FROM {name}_f, {name}_s WHERE {every})"""


PREVIEW = "CASE WHEN length({0}) > 160 THEN substring({0}, 1, 160) || '...' ELSE {0} END"
POWER = "(1 - exp(-0.1 * greatest(-score, 0))) * 100"
DOCS = "(SELECT doc_id AS id, doc_id // 8 AS article_id, lang AS title, text AS content FROM documents)"
OWNED = f"(SELECT s.* FROM {DOCS} s WHERE s.article_id IN (SELECT p_partkey FROM part))"


def sql_title(text: str) -> str:
    return f"""{sql_scores("ts", "part", "p_partkey", ["p_name"], text)},
tk AS (SELECT * FROM ts ORDER BY score, doc_id LIMIT {LIMIT}),
t AS (SELECT doc_id AS article_id, p_name AS title, coalesce((SELECT arg_min(content, id) FROM {DOCS} s WHERE s.article_id = doc_id), '') AS text, 'T' AS type,
 {POWER} AS power, score, doc_id AS hit FROM tk JOIN part ON p_partkey = doc_id)"""


def sql_content(text: str) -> str:
    return f"""{sql_scores("cs", DOCS, "id", ["title", "content"], text)},
ck AS (SELECT cs.* FROM cs WHERE doc_id IN (SELECT id FROM {OWNED}) ORDER BY score, doc_id LIMIT {LIMIT}),
c AS (SELECT s.article_id, p_name AS title, s.content AS text, 'C' AS type, {POWER} AS power, score, doc_id AS hit
 FROM ck JOIN {DOCS} s ON s.id = doc_id JOIN part ON p_partkey = s.article_id)"""


def sql_fuse(name: str, stages: list[tuple[str, str]]) -> str:
    """Noisy-OR over stages (table, order); a product is the ordered fold up to rounding."""
    rows = " UNION ALL ".join(f"SELECT article_id, title, text, type, power, {k} AS stage, row_number() OVER (ORDER BY {order}) AS rank FROM {t}" for k, (t, order) in enumerate(stages))
    return f"""{name}_r AS ({rows}),
{name} AS (SELECT article_id, arg_min(title, stage * 1000 + rank) AS title, arg_min(text, stage * 1000 + rank) AS text, arg_min(type, stage * 1000 + rank) AS type,
 round(100 * (1 - product(1 - power / 100)), 6) AS power, min(stage * 1000 + rank) AS ord FROM {name}_r GROUP BY article_id ORDER BY power DESC, ord LIMIT {LIMIT})"""


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


UNIT16 = f"(SELECT vec_id AS id, list_transform(embedding[1:{SHORT}]::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding[1:{SHORT}]::DOUBLE[], embedding[1:{SHORT}]::DOUBLE[]))) AS e FROM embeddings)"
#: Cells by fixed seeds, every fiftieth vector: the first step of the clustering.
SEEDS = f"""u AS MATERIALIZED (SELECT id, e, row_number() OVER (ORDER BY id) - 1 AS r FROM {UNIT16}),
k AS (SELECT greatest(1, count(*) // {CELL}) AS k, count(*) AS n FROM u),
s AS MATERIALIZED (SELECT i + 1 AS cid, e AS c FROM (SELECT unnest(range(k)) AS i, k, n FROM k) x JOIN u ON r = i * n // k),
a AS MATERIALIZED (SELECT id, e, arg_max(cid, [round(list_dot_product(e, c), 12), -cid]) AS centroid_id FROM u, s GROUP BY id, e)"""


# Tokens, index, full text -------------------------------------------------------------


@query(f"SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest({toks('text')}) AS t FROM documents) GROUP BY ALL")
def tokenize_terms(spark, sf_dir):
    """Instances of each term in each document."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"SELECT t AS term, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM (SELECT doc_id, unnest({toks('text')}) AS t FROM documents) GROUP BY 1")
def vocab_row(spark, sf_dir):
    return index.term_rows(index.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"]))


@query(f"SELECT unnest({toks('p_name')}) AS term FROM part UNION SELECT unnest({toks('text')}) FROM documents UNION SELECT unnest({toks('lang')}) FROM documents")
def vocab_union_distinct(spark, sf_dir):
    return index.vocabulary(index.postings(articles(spark, sf_dir), "id", ["title"]), index.postings(sections(spark, sf_dir), "id", ["title", "content"]))


@query(f"SELECT count(*) AS n_docs, sum(len({toks('text')}) + len({toks('lang')}))::BIGINT AS n_tokens FROM documents")
def corpus_statistics(spark, sf_dir):
    return index.corpus(index.lengths(sections(spark, sf_dir), "id", ["title", "content"]))


def title_index(spark, sf_dir):
    return search.Index(articles(spark, sf_dir), "id", ["title"])


def content_index(spark, sf_dir):
    return search.Index(sections(spark, sf_dir), "id", ["title", "content"])


#: Titles are shorter than a snippet, so the whole title is marked.
MARKED = f"regexp_replace(title, '\\b({TITLE_QUERY.replace(' ', '|')})\\b', '<mark>\\1</mark>', 'gi')"


@query(f"WITH {sql_title(TITLE_QUERY)} SELECT article_id, title, text, round(power, 6) AS power, {MARKED} AS snippet FROM t")
def title_bm25_topk(spark, sf_dir):
    return search.titles(title_index(spark, sf_dir), sections(spark, sf_dir), TITLE_QUERY, LIMIT).select("article_id", "title", "text", F.round("power", 6).alias("power"), "snippet")


@query(f"WITH {sql_content(CONTENT_QUERY)} SELECT article_id, title, text, hit AS section_id, round(power, 6) AS power FROM c")
def content_bm25_topk(spark, sf_dir):
    out = search.contents(content_index(spark, sf_dir), articles(spark, sf_dir), CONTENT_QUERY, LIMIT, snippets=False)
    return out.select("article_id", "title", "text", F.col("hit").alias("section_id"), F.round("power", 6).alias("power"))


@query(f"WITH {sql_scores('m', DOCS, 'id', ['title', 'content'], PHRASE_QUERY)} SELECT doc_id, f0 AS n FROM m_f WHERE f0 > 0")
def phrase_match(spark, sf_dir):
    """Rows in which the words of one phrase stand side by side."""
    wanted = X.phrases(PHRASE_QUERY)
    post = index.postings(sections(spark, sf_dir), "id", ["title", "content"], [t for p in wanted for t in p])
    return search.frequencies(post, wanted).where("f0 > 0").select("doc_id", F.col("f0").alias("n"))


@query(f"WITH {sql_scores('m', DOCS, 'id', ['title', 'content'], CONTENT_QUERY)} SELECT doc_id FROM m_f WHERE f0 > 0 AND f1 > 0")
def and_match(spark, sf_dir):
    wanted = X.phrases(CONTENT_QUERY)
    post = index.postings(sections(spark, sf_dir), "id", ["title", "content"], [t for p in wanted for t in p])
    return search.frequencies(post, wanted).where("f0 > 0 AND f1 > 0").select("doc_id")


@query(f"WITH {sql_scores('m', DOCS, 'id', ['title', 'content'], 'en the')} SELECT doc_id, round(score, 6) AS score FROM m")
def bm25_idf_clamp(spark, sf_dir):
    """Words that most rows have: their weight is clamped, not negative."""
    return content_index(spark, sf_dir).scores("en the").select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {sql_scores('m', DOCS, 'id', ['title', 'content'], CONTENT_QUERY)} SELECT doc_id, round({POWER}, 6) AS power FROM m")
def power_normalize(spark, sf_dir):
    return content_index(spark, sf_dir).scores(CONTENT_QUERY).select("doc_id", F.round(X.power(F.round("score", 6)), 6).alias("power"))


@query(f"SELECT doc_id, {PREVIEW.format('text')} AS snippet FROM documents")
def snippet_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("snippet"))


@query()
def snippet_marked(spark, sf_dir):
    """The marked windows of the best sections."""
    out = search.contents(content_index(spark, sf_dir), articles(spark, sf_dir), CONTENT_QUERY, LIMIT)
    return out.select("article_id", F.col("hit").alias("section_id"), "snippet")


@query(f"SELECT t AS text, levenshtein(t, 'thinge')::DOUBLE AS power FROM (SELECT DISTINCT unnest({toks('text')}) AS t FROM documents) WHERE regexp_full_match(t, '[a-z0-9]+') ORDER BY power, text LIMIT {LIMIT}")
def levenshtein_topk(spark, sf_dir):
    """Over words of plain letters: the oracle's distance counts bytes."""
    words = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).where(F.col("term").rlike("^[a-z0-9]+$"))
    return search.nearest_words(words, "thinge", LIMIT)


# Sections, articles, settings ---------------------------------------------------------


@query(f"SELECT id, article_id, title FROM {DOCS} QUALIFY row_number() OVER (PARTITION BY article_id, title ORDER BY id DESC) = 1")
def section_dedup_last(spark, sf_dir):
    return store.dedup_sections(sections(spark, sf_dir).select("id", "article_id", "title"))


@query("SELECT max(l_shipdate) AS last_ship, l_partkey, l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey")
def group_max_last(spark, sf_dir):
    """The greatest value per pair of keys, as the section dedup keeps it."""
    return store.newest_ids(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_shipdate").withColumnRenamed("l_shipdate", "last_ship")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def article_upsert_last(spark, sf_dir):
    """Of the writes to one key the last stays."""
    return store.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], [F.desc("o_orderkey")])


@query(f"SELECT p.p_partkey AS id, p.p_name AS title, p.p_brand AS entity, s.id AS section_id, s.title AS section_title, s.content FROM part p JOIN {DOCS} s ON s.article_id = p.p_partkey WHERE p.p_partkey = 7")
def article_get(spark, sf_dir):
    a = store.article(articles(spark, sf_dir), sections(spark, sf_dir), 7)
    return a.select("id", "title", "entity", F.explode("sections").alias("s")).select("id", "title", "entity", F.col("s.id").alias("section_id"), F.col("s.title").alias("section_title"), "s.content")


@query(f"SELECT article_id, arg_min(content, id) AS text FROM {DOCS} GROUP BY article_id")
def first_section_text(spark, sf_dir):
    return search.first_sections(sections(spark, sf_dir))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def pending_sections(spark, sf_dir):
    return store.pending(sections(spark, sf_dir).select("id"), vectors(spark, sf_dir))


@query(f"SELECT s.id, 'doc: ' || p_name || ' - ' || title || chr(10) || chr(10) || content AS input FROM {DOCS} s JOIN part ON p_partkey = article_id")
def embedding_text(spark, sf_dir):
    return store.embedding_text(sections(spark, sf_dir), articles(spark, sf_dir), "doc: ")


@query("SELECT count(*) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def nonempty_count(spark, sf_dir):
    return store.nonempty(table(spark, sf_dir, "documents"), "text")


@query("SELECT n_name AS key, max(n_nationkey) AS value FROM nation WHERE n_name = (SELECT min(n_name) FROM nation) GROUP BY 1")
def setup_settings(spark, sf_dir):
    """Upserted settings, one read back."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value"))
    kept = store.last_wins(rows, ["key"], [F.desc("value")])
    least = rows.agg(F.min("key").alias("key"))
    return kept.join(F.broadcast(least), "key").limit(1)


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_id, (SELECT coalesce(max(o_orderkey), 0) + 1 FROM orders WHERE o_orderkey < 0) AS first_id FROM orders")
def next_chunk_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    next_id, first_id = store.next_id(o, "o_orderkey"), store.next_id(o.where("o_orderkey < 0"), "o_orderkey")
    return spark.createDataFrame([(next_id, first_id)], "next_id long, first_id long")


@query("SELECT DISTINCT p_brand, coalesce(try_cast(nullif(regexp_extract(p_brand, '\\d+'), '') AS BIGINT), 0) AS level, coalesce(try_cast(nullif(regexp_extract(p_type, '\\d+'), '') AS BIGINT), 0) AS none FROM part")
def heading_level(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_brand", X.first_number(F.col("p_brand")).alias("level"), X.first_number(F.col("p_type")).alias("none")).distinct()


RELEASES = "CASE WHEN l_linenumber = 1 THEN 'set' || l_suppkey || '.db.gz' WHEN l_linenumber = 7 THEN 'set' || l_suppkey || '.txt' ELSE 'set' || l_suppkey || '.db-' || l_linenumber || '.gz' END"


@query(f"SELECT base, string_agg(name, ',' ORDER BY name) AS files FROM (SELECT DISTINCT {RELEASES} AS name, split_part({RELEASES}, '.db', 1) AS base FROM lineitem) WHERE regexp_matches(name, '\\.db(-\\d+)?\\.gz$') GROUP BY 1")
def db_file_groups(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").select(F.expr(RELEASES).alias("name")).distinct()
    return releases.databases(names).select("base", F.array_join("files", ",").alias("files"))


# Vectors ------------------------------------------------------------------------------

Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id AS id, round({dot_sql('embedding', Q)}, 9) AS sim FROM embeddings ORDER BY sim DESC, id LIMIT {LIMIT}")
def dot_topk(spark, sf_dir):
    return ivf.similar(vectors(spark, sf_dir), vector(spark, sf_dir), LIMIT)


@query(f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {Q}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT {LIMIT}")
def euclidean_topk(spark, sf_dir):
    q = V.literal(vector(spark, sf_dir))
    return vectors(spark, sf_dir).select("id", F.round(V.euclidean(F.col("embedding"), q), 6).alias("distance")).orderBy("distance", "id").limit(LIMIT)


@query(f"SELECT e.vec_id AS id, len(list_filter(range(1, 65), lambda i: (e.embedding[i] > 0) <> (q.embedding[i] > 0))) AS distance FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY distance, id LIMIT {LIMIT}")
def hamming_topk(spark, sf_dir):
    """Distance of the sign bits, packed in bytes."""
    e = vectors(spark, sf_dir).select("id", V.sign_bytes(F.col("embedding"), 64).alias("bits"))
    q = e.where(F.col("id") == 0).select(F.col("bits").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("id", V.hamming(F.col("bits"), F.col("q")).cast("long").alias("distance")).orderBy("distance", "id").limit(LIMIT)


@query("SELECT vec_id AS id, i AS place, round(x / sqrt(n), 6) + 0.0 AS value FROM (SELECT vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n, unnest(embedding::DOUBLE[]) AS x, unnest(range(64))::INT AS i FROM embeddings)")
def l2_normalize(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.posexplode(V.unit(F.col("embedding"))).alias("place", "value")).select("id", "place", (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH u AS {UNIT16} SELECT u.id, round(list_dot_product(u.e, q.e), 9) AS sim FROM u, u q WHERE q.id = 0 ORDER BY sim DESC, u.id LIMIT {LIMIT}")
def mrl_truncate_topk(spark, sf_dir):
    short = ivf.truncated(vectors(spark, sf_dir), SHORT)
    q = short.where(F.col("id") == 0).select(F.col("embedding").alias("q"))
    return short.crossJoin(F.broadcast(q)).select("id", F.round(V.dot(F.col("embedding"), F.col("q")), 9).alias("sim")).orderBy(F.desc("sim"), "id").limit(LIMIT)


def seeded(spark, sf_dir):
    """Truncated vectors, and the seeds of the clustering as a matrix."""
    import numpy as np

    short = ivf.truncated(vectors(spark, sf_dir), SHORT)
    rows = ivf.numbered(short)
    n = rows.count()
    k = max(1, n // CELL)
    places = [i * n // k for i in range(k)]
    picked = {r["row"]: r["embedding"] for r in rows.where(F.col("row").isin(places)).collect()}
    return short, np.array([picked[p] for p in places])


@query(f"WITH {SEEDS} SELECT id, centroid_id FROM a")
def ivf_assign(spark, sf_dir):
    """One assignment of vectors to their most similar cell."""
    short, seeds = seeded(spark, sf_dir)
    return ivf.assigned(short, seeds).select("id", "centroid_id")


@query(f"""WITH {SEEDS}, t AS (SELECT centroid_id, i, sum(x) AS x FROM (SELECT centroid_id, unnest(e) AS x, unnest(range({SHORT}))::INT AS i FROM a) GROUP BY 1, 2)
SELECT centroid_id, i AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY centroid_id)), 6) + 0.0 AS value FROM t""")
def ivf_update(spark, sf_dir):
    """One round: the normalised sum of each cell's vectors."""
    centroids, _ = ivf.kmeans(ivf.truncated(vectors(spark, sf_dir), SHORT), CELL, rounds=1)
    rows = spark.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(centroids)], "centroid_id int, c array<double>")
    return rows.select("centroid_id", F.posexplode("c").alias("place", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query(f"""WITH {SEEDS}, p AS (SELECT id, centroid_id, row_number() OVER (PARTITION BY centroid_id ORDER BY id) - 1 AS p FROM a),
c AS (SELECT centroid_id, p // 20 AS c FROM p GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY centroid_id, c) AS chunk_id FROM c)
SELECT id AS section_id, p.centroid_id, chunk_id, (p % 20)::INT AS pos FROM p JOIN n ON n.centroid_id = p.centroid_id AND n.c = p.p // 20""")
def ivf_layout(spark, sf_dir):
    """Slots of vectors in chunks of their cells (of 20, so that cells have several)."""
    short, seeds = seeded(spark, sf_dir)
    return ivf.layout(ivf.assigned(short, seeds), 20).select("section_id", "centroid_id", "chunk_id", "pos")


def sql_rounds(rounds: int) -> str:
    """The clustering's rounds one after another: c0 are the seeds, c{r} follows r updates."""
    sums = ", ".join(f"sum(e[{d}])" for d in range(1, SHORT + 1))
    out = ["u AS MATERIALIZED (SELECT id, e, row_number() OVER (ORDER BY id) - 1 AS r FROM " + UNIT16 + ")", f"k AS (SELECT greatest(1, count(*) // {CELL}) AS k, count(*) AS n FROM u)",
           "w AS MATERIALIZED (SELECT i, i * n // k AS seed, 7 * i % n AS spare FROM (SELECT unnest(range(k)) AS i, k, n FROM k))",
           "c0 AS MATERIALIZED (SELECT i + 1 AS cid, e AS c FROM w JOIN u ON r = seed)"]
    for r in range(rounds):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, e, arg_max(cid, [round(list_dot_product(e, c), 12), -cid]) AS centroid_id FROM u, c{r} GROUP BY id, e)")
        out.append(f"m{r} AS (SELECT centroid_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS c FROM (SELECT centroid_id, [{sums}] AS v FROM a{r} GROUP BY 1))")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT i + 1 AS cid, coalesce(m.c, u.e) AS c FROM w LEFT JOIN m{r} m ON m.centroid_id = i + 1 JOIN u ON u.r = spare)")
    return ",\n".join(out)


@query(f"""WITH {sql_rounds(ivf.ROUNDS)}, p AS (SELECT id, centroid_id, row_number() OVER (PARTITION BY centroid_id ORDER BY id) - 1 AS p FROM a{ivf.ROUNDS - 1}),
c AS (SELECT centroid_id, p // {CELL} AS c FROM p GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (ORDER BY centroid_id, c) AS chunk_id FROM c)
SELECT id AS section_id, p.centroid_id, chunk_id, (p % {CELL})::INT AS pos FROM p JOIN n ON n.centroid_id = p.centroid_id AND n.c = p.p // {CELL}""")
def ivf_build(spark, sf_dir):
    """The whole clustering, as the layout of its last assignment."""
    _, cells = ivf.kmeans(ivf.truncated(vectors(spark, sf_dir), SHORT), CELL)
    return ivf.layout(cells, CELL).select("section_id", "centroid_id", "chunk_id", "pos")


PROBES = f"""b AS (SELECT s.cid, s.c, round(list_dot_product(s.c, q.e), 9) AS sim, coalesce(n, 0) AS n FROM s JOIN u q ON q.id = 0 LEFT JOIN (SELECT centroid_id, count(*) AS n FROM a GROUP BY 1) z ON z.centroid_id = s.cid),
w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sim DESC, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (ORDER BY sim DESC, cid) AS rank FROM b),
pr AS (SELECT cid FROM w WHERE before < greatest({PROBE_LIMIT} * {CELL}, {FLOOR} * {CELL}) OR rank <= 2),
pw AS (SELECT cid FROM w WHERE before < greatest({PROBE_LIMIT * PROBE_LIMIT} * {CELL}, {FLOOR} * {CELL}) OR rank <= 2)"""


def built(spark, sf_dir):
    """Layout and centroids of the seeded cells."""
    short, seeds = seeded(spark, sf_dir)
    centroids = spark.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(seeds)], "id int, centroid array<double>")
    q = short.where(F.col("id") == 0).first()["embedding"]
    return ivf.layout(ivf.assigned(short, seeds), CELL), centroids, q


@query(f"WITH {SEEDS}, {PROBES} SELECT cid AS centroid_id FROM pr")
def centroid_probe(spark, sf_dir):
    ann, centroids, q = built(spark, sf_dir)
    return ivf.probes(centroids, ann.groupBy("centroid_id").agg(F.count("*").alias("n")), q, PROBE_LIMIT, CELL, FLOOR)


ANN_HITS = f"""h AS (SELECT a.id, round(list_dot_product(a.e, q.e), 9) AS sim FROM a, u q WHERE q.id = 0 AND a.centroid_id IN (SELECT cid FROM pw) ORDER BY sim DESC, a.id LIMIT {PROBE_LIMIT * PROBE_LIMIT})"""


@query(f"WITH {SEEDS}, {PROBES}, {ANN_HITS} SELECT id, sim FROM h")
def ann_topk(spark, sf_dir):
    ann, centroids, q = built(spark, sf_dir)
    return ivf.search(ann, centroids, q, PROBE_LIMIT * PROBE_LIMIT, CELL, FLOOR)


def sql_shown(hits: str) -> str:
    """Result rows of vector hits (id, sim)."""
    text = "CASE WHEN p_name IS NULL THEN '' ELSE content END"
    return f"""SELECT (CASE WHEN p_name IS NULL THEN 0 ELSE article_id END)::BIGINT AS article_id, coalesce(p_name, '') AS title, {text} AS text, 'V' AS type,
 round(greatest(0, least(100, (sim + 1) / 2 * 100)), 6) AS power, {PREVIEW.format(text)} AS snippet FROM ({hits}) x LEFT JOIN {DOCS} s ON s.id = x.id LEFT JOIN part ON p_partkey = article_id"""


@query(f"WITH {SEEDS}, {PROBES}, {ANN_HITS} " + sql_shown(f"SELECT vec_id AS id, round({dot_sql('embedding', Q)}, 9) AS sim FROM embeddings WHERE vec_id IN (SELECT id FROM h) ORDER BY sim DESC, id LIMIT {PROBE_LIMIT}"))
def ann_rerank(spark, sf_dir):
    """Vector search with lists and whole vectors: candidates by short ones, ranked by whole ones."""
    ann, centroids, _ = built(spark, sf_dir)
    return search.plain(ivf.semantic(sections(spark, sf_dir), articles(spark, sf_dir), vector(spark, sf_dir), PROBE_LIMIT, vectors(spark, sf_dir), ann, centroids, SHORT, CELL, FLOOR))


@query(f"WITH {SEEDS}, {PROBES} " + sql_shown(f"SELECT a.id, round(list_dot_product(a.e, q.e), 9) AS sim FROM a, u q WHERE q.id = 0 AND a.centroid_id IN (SELECT cid FROM pr) ORDER BY sim DESC, a.id LIMIT {PROBE_LIMIT}"))
def ann_only_search(spark, sf_dir):
    """Vector search with lists alone: their own order."""
    ann, centroids, _ = built(spark, sf_dir)
    return search.plain(ivf.semantic(sections(spark, sf_dir), articles(spark, sf_dir), vector(spark, sf_dir), PROBE_LIMIT, None, ann, centroids, SHORT, CELL, FLOOR))


SEMANTIC = f"""vh AS (SELECT vec_id AS id, round({dot_sql('embedding', Q)}, 9) AS sim FROM embeddings ORDER BY sim DESC, id LIMIT {LIMIT}),
v AS (SELECT CASE WHEN p_name IS NULL THEN 0 ELSE article_id END AS article_id, coalesce(p_name, '') AS title, CASE WHEN p_name IS NULL THEN '' ELSE content END AS text, 'V' AS type,
 round(greatest(0, least(100, (sim + 1) / 2 * 100)), 6) AS power, -sim AS score, vh.id AS hit FROM vh LEFT JOIN {DOCS} s ON s.id = vh.id LEFT JOIN part ON p_partkey = article_id)"""


@query(f"WITH {SEMANTIC} SELECT article_id, title, text, type, power, {PREVIEW.format('text')} AS snippet FROM v")
def semantic_search(spark, sf_dir):
    return search.plain(ivf.semantic(sections(spark, sf_dir), articles(spark, sf_dir), vector(spark, sf_dir), LIMIT, vectors(spark, sf_dir)))


# Fusion -------------------------------------------------------------------------------


@query("SELECT user_id AS article_id, round(100 * (1 - product(1 - value / 100)), 4) AS power FROM (SELECT user_id, least(abs(value), 90) * 0.987654321 AS value FROM events WHERE event_id < 500) GROUP BY 1 ORDER BY power DESC, min(article_id) LIMIT 100000")
def fusion_noisy_or(spark, sf_dir):
    """Fusion of events by user, their values as powers."""
    e = table(spark, sf_dir, "events").where("event_id < 500")
    rows = e.select(F.col("user_id").alias("article_id"), F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("type"), (F.least(F.abs("value"), F.lit(90.0)) * 0.987654321).alias("power"), F.lit("").alias("snippet"), F.struct(F.lit(0).alias("stage"), F.col("event_id").cast("int").alias("rank")).alias("ord"))
    return fusion.fuse(rows, 100000).select("article_id", F.round("power", 4).alias("power"))


LEXICAL = f"{sql_title(BOTH_QUERY)},\n{sql_content(BOTH_QUERY)},\n{sql_fuse('lx', [('t', 'score, hit'), ('c', 'score, hit')])}"


@query(f"WITH {LEXICAL} SELECT article_id, title, text, type, power FROM lx")
def lexical_search(spark, sf_dir):
    return search.lexical(title_index(spark, sf_dir), content_index(spark, sf_dir), BOTH_QUERY, LIMIT).select("article_id", "title", "text", "type", "power")


@query(f"WITH {LEXICAL}, {SEMANTIC}, {sql_fuse('cb', [('lx', 'power DESC, ord'), ('v', 'score, hit')])} SELECT article_id, title, text, type, power FROM cb")
def combined_search(spark, sf_dir):
    """Lexical results cut to the limit, then semantic ones fused in and cut again."""
    lexical = search.lexical(title_index(spark, sf_dir), content_index(spark, sf_dir), BOTH_QUERY, LIMIT)
    more = ivf.semantic(sections(spark, sf_dir), articles(spark, sf_dir), vector(spark, sf_dir), LIMIT, vectors(spark, sf_dir))
    return fusion.refuse(lexical, more, LIMIT).select("article_id", "title", "text", "type", "power")


# Pages, codecs, ingest ----------------------------------------------------------------


@query()
def html_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where(F.length("html") > 0)
    items = pages.select("page_id", H.sectioned("html").alias("items")).where(F.size("items") > 0)
    return items.select("page_id", F.posexplode("items").alias("place", "item")).select("page_id", "place", "item.*")


LETTERS = "trim(regexp_replace(text, '[^A-Za-z ]', '', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, lang, {LETTERS} AS t FROM documents WHERE length({LETTERS}) > 0)
SELECT doc_id, 0 AS place, '' AS title, 0 AS pow, 'intro ' || lang AS content FROM d
UNION ALL SELECT doc_id, 1, 'About ' || lang, 2, t || chr(10) || chr(10) || '• ' || lang FROM d
UNION ALL SELECT doc_id, 2, 'More', 3, 'end' FROM d""")
def html_sections_made(spark, sf_dir):
    """Pages made of documents: hidden parts, an external link, a repeated heading and an empty one."""
    letters = F.trim(F.regexp_replace("text", "[^A-Za-z ]", ""))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", letters.alias("t")).where(F.length("t") > 0)
    page = F.concat(
        F.lit("<html><style>p{}</style><p>intro "), "lang", F.lit("<h2>About "), "lang", F.lit("</h2><p>"), "t", F.lit("<sup class='reference'>[1]</sup></p><h4>Empty</h4><h3>More</h3><p>end<script>x</script></p>"),
        F.lit("<h2>About "), "lang", F.lit("</h2><ul><li>"), "lang", F.lit("</li><li><a class='external text' href='u'>gone</a></li></ul><div>bare</div>"),
    )
    items = d.select("doc_id", H.sectioned(page).alias("items"))
    return items.select("doc_id", F.posexplode("items").alias("place", "item")).select("doc_id", "place", "item.title", "item.pow", "item.content")


@query("SELECT page_id, page_id % 3 = 0 AS external FROM pages")
def external_link_filter(spark, sf_dir):
    """Pages to a third of which an external link is added, to another third an inner one."""
    link = F.when(F.col("page_id") % 3 == 0, "<p><b><a href='u' class='x external text'>t</a></b></p>").when(F.col("page_id") % 3 == 1, "<a class='internal' title='external'>t</a>").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", H.has_external(F.concat("html", link)).alias("external"))


@query("SELECT doc_id, repeat(text, 4) AS text, true AS same, true AS shrunk FROM documents WHERE length(text) >= 50")
def deflate_roundtrip(spark, sf_dir):
    """Repeated texts deflated, which makes them smaller, and inflated again."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 50).select("doc_id", F.repeat("text", 4).alias("whole"))
    z = d.withColumn("z", X.deflate("whole"))
    back = z.select("doc_id", "whole", X.inflate("z").alias("text"), F.length("z").alias("size"))
    return back.select("doc_id", "text", (F.col("text") == F.col("whole")).alias("same"), (F.col("size") < F.octet_length("whole")).alias("shrunk"))


@query("""SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN repeat(text, 4) WHEN 1 THEN text[1:1] ELSE '' END AS content,
doc_id % 3 = 0 AS packed, doc_id % 3 <> 0 AS plain FROM documents WHERE length(text) >= 50""")
def compress_if_smaller(spark, sf_dir):
    """Long contents are packed and lose their text; single letters and empty ones stay; all are read back."""
    kind = F.col("id") % 3
    rows = sections(spark, sf_dir).where(F.length("content") >= 50)
    rows = rows.withColumn("content", F.when(kind == 0, F.repeat("content", 4)).when(kind == 1, F.substring("content", 1, 1)).otherwise(F.lit(""))).withColumn("content_flate", F.lit(None).cast("binary"))
    kept = store.compressed(rows)
    told = kept.withColumn("packed", F.col("content").isNull() & F.col("content_flate").isNotNull()).withColumn("plain", F.col("content").isNotNull() & F.col("content_flate").isNull())
    return store.readable(told).select("id", "content", "packed", "plain")


@query("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events WHERE event_type <> ''")
def jsonl_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> ''")
    return e.select("event_id", F.coalesce(F.from_json("props", "struct<k:bigint>")["k"], F.lit(0)).alias("k"))


@query("SELECT page_id AS id, url AS title, '' AS entity, length(html) AS size FROM pages WHERE length(html) > 0")
def jsonl_ingest(spark, sf_dir):
    """Pages written as JSON records and read by the ingest parser."""
    p = table(spark, sf_dir, "pages")
    body = F.to_json(F.struct(F.col("page_id").alias("identifier"), F.col("url").alias("name"), F.struct("html").alias("article_body")))
    lines = p.select(F.lit("a").alias("archive"), F.lit("m").alias("member"), F.col("page_id").alias("line"), body.alias("value"))
    return archive.articles(lines).select("id", "title", "entity", F.length("html").alias("size"))


@query("SELECT vec_id AS id, unnest(range(64))::INT AS place, unnest(embedding)::DOUBLE AS value FROM embeddings")
def vector_codec(spark, sf_dir):
    """To little-endian bytes and back."""
    back = vectors(spark, sf_dir).select("id", V.from_bytes(V.to_bytes("embedding")).alias("embedding"))
    return back.select("id", F.posexplode("embedding").alias("place", "value")).withColumn("value", F.col("value").cast("double"))


# The stored engine --------------------------------------------------------------------

_stores: dict[tuple[str, str], store.Engine] = {}


def engine(spark, sf_dir) -> store.Engine:
    """The driver's tables as a store, with compressed sections, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="store-")
        made = store.Engine(spark, f"{base}/store-{uuid.uuid4().hex}")
        rows = sections(spark, sf_dir).select("id", "article_id", "title", "content", F.lit(None).cast("binary").alias("content_flate"), F.lit(0).alias("pow"))
        made.commit({"articles": articles(spark, sf_dir), "sections": store.compressed(rows), "vectors": vectors(spark, sf_dir)})
        made.build_index()
        _stores[key] = made
    return _stores[key]


@query(f"WITH {sql_title(TITLE_QUERY)} SELECT article_id, title, text, type, round(power, 6) AS power, {MARKED} AS snippet FROM t")
def engine_search_title(spark, sf_dir):
    return engine(spark, sf_dir).search_title(TITLE_QUERY, LIMIT).withColumn("power", F.round("power", 6))


@query(f"WITH {sql_content(CONTENT_QUERY)} SELECT article_id, title, text, type, round(power, 6) AS power FROM c")
def engine_search_content(spark, sf_dir):
    """Snippets of contents have no SQL; tests hold them against another engine's."""
    return engine(spark, sf_dir).search_content(CONTENT_QUERY, LIMIT).withColumn("power", F.round("power", 6)).drop("snippet")


@query(f"WITH {sql_content('the-of')} SELECT article_id, title, text, type, round(power, 6) AS power FROM c")
def engine_search_phrase(spark, sf_dir):
    return engine(spark, sf_dir).search_content("the-of", LIMIT).withColumn("power", F.round("power", 6)).drop("snippet")


@query(f"WITH {LEXICAL} SELECT article_id, title, text, type, power FROM lx")
def engine_search_lexical(spark, sf_dir):
    return engine(spark, sf_dir).search_lexical(BOTH_QUERY, LIMIT).drop("snippet")


@query(f"WITH {LEXICAL}, {SEMANTIC}, {sql_fuse('cb', [('lx', 'power DESC, ord'), ('v', 'score, hit')])} SELECT article_id, title, text, type, power FROM cb")
def engine_search(spark, sf_dir):
    return engine(spark, sf_dir).search(BOTH_QUERY, LIMIT, vector(spark, sf_dir)).drop("snippet")


@query(f"WITH {SEMANTIC} SELECT article_id, title, text, type, power, {PREVIEW.format('text')} AS snippet FROM v")
def engine_search_semantic(spark, sf_dir):
    return engine(spark, sf_dir).search_semantic(vector(spark, sf_dir), LIMIT)


@query(f"""SELECT 0::BIGINT AS article_id, '' AS title, t AS text, '' AS type, levenshtein(t, 'ring')::DOUBLE AS power, '' AS snippet FROM (SELECT unnest({toks('p_name')}) AS t FROM part
UNION SELECT unnest({toks('text')}) FROM documents UNION SELECT unnest({toks('lang')}) FROM documents) WHERE regexp_full_match(t, '[a-z0-9]+') ORDER BY power, text LIMIT {LIMIT}""")
def engine_search_distance(spark, sf_dir):
    """The nearest words of the stored vocabulary (all of plain letters: the oracle's distance counts bytes)."""
    return engine(spark, sf_dir).search_distance("ring", LIMIT)


@query(f"SELECT p.p_partkey AS id, p.p_name AS title, p.p_brand AS entity, s.id AS section_id, s.title AS section_title, s.content FROM part p JOIN {DOCS} s ON s.article_id = p.p_partkey WHERE p.p_partkey = 7")
def engine_article(spark, sf_dir):
    a = engine(spark, sf_dir).article(7)
    rows = [(a["id"], a["title"], a["entity"], s["id"], s["title"], s["content"]) for s in a["sections"]]
    return spark.createDataFrame(rows, "id long, title string, entity string, section_id long, section_title string, content string")


@query(f"SELECT t AS term FROM (SELECT unnest({toks('p_name')}) AS t FROM part UNION SELECT unnest({toks('text')}) FROM documents UNION SELECT unnest({toks('lang')}) FROM documents)")
def engine_vocabulary(spark, sf_dir):
    return engine(spark, sf_dir).table("vocabulary")


@query(f"SELECT count(*) AS n_docs, sum(len({toks('text')}) + len({toks('lang')}))::BIGINT AS n_tokens FROM documents")
def engine_corpus(spark, sf_dir):
    """The corpus as counted from stored postings."""
    return spark.createDataFrame([tuple(engine(spark, sf_dir).mark("corpus")["content"].values())], "n_docs long, n_tokens long")


@query(f"SELECT id AS section_id, 'pending: ' || p_name || ' - ' || title || chr(10) || chr(10) || content AS input FROM {DOCS} s JOIN part ON p_partkey = article_id WHERE id NOT IN (SELECT vec_id FROM embeddings)")
def engine_pending_texts(spark, sf_dir):
    """What would be embedded next: sections without a vector, inflated, with their prefix."""
    e = engine(spark, sf_dir)
    return store.embedding_text(store.pending(e.sections, e.table("vectors")), e.articles, "pending: ").withColumnRenamed("id", "section_id")
