"""Title, content, lexical and edit-distance search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import RESULT_COLUMNS
from . import fusion, index

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def frequencies(post: DataFrame, phrases: Sequence[Sequence[str]], also: Sequence[str] = ()) -> DataFrame:
    """doc_id, f0, f1, …: instances of each distinct phrase, and columns that each row has one of.

    One shuffle by row.  A lone word is only counted; the positions of other terms are
    gathered per row and column, and a phrase occurs where its terms' places, each
    moved back by its offset, coincide."""
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    terms = sorted({t for p in distinct for t in p})
    together = sorted({t for p in distinct if len(p) > 1 for t in p})
    number = {t: i for i, t in enumerate(together)}
    # partitioned by row alone, so that both groupings and the join with lengths share it
    mine = post.where(F.col("term").isin(terms)).repartition("doc_id")
    keep = [F.first(c).alias(c) for c in also]

    def lone(i: int):
        return F.count(F.when(F.col("term") == distinct[i][0], 1)).alias(f"f{i}")

    if not together:
        return mine.groupBy("doc_id").agg(*[lone(i) for i in range(len(distinct))], *keep)
    places = [F.collect_list(F.when(F.col("term") == t, F.col("pos"))).alias(f"p{i}") for t, i in number.items()]
    gathered = mine.groupBy("doc_id", "col").agg(*places, *[lone(i) for i, p in enumerate(distinct) if len(p) == 1], *keep)

    def moved(term: str, by: int):
        return F.transform(f"p{number[term]}", lambda x: x - by)

    def count(i: int):
        phrase = distinct[i]
        if len(phrase) == 1:
            return F.col(f"f{i}")
        out = F.col(f"p{number[phrase[0]]}")
        for k, t in enumerate(phrase[1:], 1):
            out = F.array_intersect(out, moved(t, k))
        return F.size(out).cast("long")

    counted = gathered.select("doc_id", *[count(i).alias(f"f{i}") for i in range(len(distinct))], *also)
    return counted.groupBy("doc_id").agg(*[F.sum(f"f{i}").cast("long").alias(f"f{i}") for i in range(len(distinct))], *keep)


def bm25(freq: DataFrame, size: DataFrame | dict[str, int], phrases: Sequence[Sequence[str]], found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, score: BM25 of the rows that have every phrase; smaller is better.

    ``found`` gives the rows of freq their length (len); ``size`` has n_docs and n_tokens,
    as one row or as numbers.  Statistics stay in the plan as
    one broadcast row, so it is a single job."""
    distinct = list(dict.fromkeys(map(tuple, phrases)))
    times = {p: sum(tuple(q) == p for q in phrases) for p in distinct}
    seen = freq.agg(*[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(distinct))])
    if "len" in freq.columns:
        # the greatest length is asked for, and used below, so that both uses of freq have
        # the same columns and share one scan and shuffle
        seen = freq.agg(*[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(distinct))], *[F.max(c).alias(f"most_{c}") for c in freq.columns if c in ("len", "owned")])
    stats = seen.crossJoin(size) if isinstance(size, DataFrame) else seen.withColumns({c: F.lit(n).cast("long") for c, n in size.items()})
    every = F.lit(True)
    for i in range(len(distinct)):
        every = every & (F.col(f"f{i}") > 0)
    rows = found(freq.where(every)).crossJoin(F.broadcast(stats))
    for c in ("len", "owned"):
        if f"most_{c}" in rows.columns:
            rows = rows.where(F.col(c) <= F.col(f"most_{c}"))
    average = F.col("n_tokens") / F.col("n_docs")
    score = F.lit(0.0)
    for i, p in enumerate(distinct):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        score = score - times[p] * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / average))
    return rows.select("doc_id", score.alias("score"))


class Index:
    """Postings and size of one searchable table.

    Either stored (postings with lengths and owners, and the size), or made from the
    rows when a query is known."""

    def __init__(self, rows: DataFrame, key: str, columns: Sequence[str], stored: tuple[DataFrame, dict[str, int]] | None = None):
        self.rows, self.key, self.columns, self.stored = rows, key, list(columns), stored

    def scores(self, query: str, owned: bool = False) -> DataFrame:
        """doc_id, score; of a stored index, with ``owned``, only rows that have an article."""
        wanted = X.phrases(query)
        if not wanted:
            return self.rows.sparkSession.createDataFrame([], "doc_id long, score double")
        if self.stored:
            post, size = self.stored
            own = (lambda rows: rows.where("owned")) if owned else (lambda rows: rows)
            return bm25(frequencies(post, wanted, ["len", "owned"] if owned else ["len"]), size, wanted, own)
        lens = index.lengths(self.rows, self.key, self.columns)
        post = index.postings(self.rows, self.key, self.columns, sorted({t for p in wanted for t in p}))
        return bm25(frequencies(post, wanted), index.corpus(lens), wanted, lambda rows: rows.join(lens, "doc_id"))


def opened(rows: DataFrame) -> DataFrame:
    """Contents inflated where they were compressed; never null."""
    whole = F.coalesce("content", X.inflate("content_flate")) if "content_flate" in rows.columns else F.col("content")
    return rows.withColumn("content", F.coalesce(whole, F.lit("")))


#: Ids of so few hits are written into the query that fetches their rows.
LITERALS = 1000


def settled(hits: DataFrame, limit: int) -> DataFrame:
    """A top-k list computed now, so that its ids can prune what is read next."""
    if limit > LITERALS:
        return hits
    return hits.sparkSession.createDataFrame(hits.toArrow(), hits.schema)


def picked(rows: DataFrame, key: str, hits: DataFrame, column: str, limit: int) -> DataFrame:
    """The rows whose key is among the settled hits'; few ids are literals, which reach the scan."""
    if limit <= LITERALS:
        return rows.where(F.col(key).isin(sorted({r[0] for r in hits.select(column).collect()})))
    return rows.join(F.broadcast(hits.select(F.col(column).alias(key)).distinct()), key, "left_semi")


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The best rows; scores are rounded before they order, and ids settle ties."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return scores.withColumn("score", F.round("score", 6)).orderBy("score", "doc_id").limit(limit)


def shown(snippet, content):
    return F.coalesce(F.when(snippet == "", None).otherwise(snippet), X.preview(content), F.lit(""))


def first_sections(sections: DataFrame) -> DataFrame:
    """article_id, text: the content of each article's section of least id."""
    flate = ["content_flate"] if "content_flate" in sections.columns else []
    first = sections.groupBy("article_id").agg(F.min_by(F.struct("content", *flate), "id").alias("s"))
    return opened(first.select("article_id", "s.*")).select("article_id", F.col("content").alias("text"))


def titles(articles: Index, sections: DataFrame, query: str, limit: int) -> DataFrame:
    """Title search: ranked articles with the text of their first section.

    Hits come first; what is shown of them is then fetched and inflated for them only."""
    hits = top(articles.scores(query), limit)
    rows, own = articles.rows, sections
    if articles.stored:
        hits = settled(hits, limit)
        rows = picked(rows, articles.key, hits, "doc_id", limit)
        own = picked(own, "article_id", hits, "doc_id", limit)
    hits = F.broadcast(hits)
    named = rows.join(hits, rows[articles.key] == hits["doc_id"])
    if not articles.stored:
        own = own.join(F.broadcast(named.select(F.col("doc_id").alias("article_id"))), "article_id", "left_semi")
    out = named.join(first_sections(own), named["doc_id"] == F.col("article_id"), "left")
    marked = X.snippets(F.col("title"), X.phrases(query), 16)
    return out.select(
        F.col("doc_id").alias("article_id"), "title", F.coalesce("text", F.lit("")).alias("text"), F.lit("T").alias("type"),
        X.power(F.col("score")).alias("power"), shown(marked, F.col("text")).alias("snippet"), F.col("score"), F.col("doc_id").alias("hit"),
    ).orderBy("score", "hit")


def contents(sections: Index, articles: DataFrame, query: str, limit: int, snippets: bool = True) -> DataFrame:
    """Content search: ranks sections whose article exists; one row per section."""
    scores, rows = sections.scores(query, owned=True), sections.rows
    if sections.stored:
        hits = settled(top(scores, limit), limit)
        rows = picked(rows, sections.key, hits, "doc_id", limit)
    else:
        # only sections with an article may take a place, so the ids go first
        owned = rows.select(F.col(sections.key).alias("doc_id"), "article_id").join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
        hits = top(scores.join(owned.select("doc_id"), "doc_id", "left_semi"), limit)
    flate = [c for c in ("content_flate",) if c in rows.columns]
    met = opened(rows.select(F.col(sections.key).alias("doc_id"), "article_id", "content", *flate).join(F.broadcast(hits), "doc_id"))
    if sections.stored:
        met = settled(met, limit)
        articles = picked(articles, "id", met, "article_id", limit)
    out = met.join(articles.select(F.col("id").alias("article_id"), "title"), "article_id")
    marked = X.snippets(F.col("content"), X.phrases(query), 64) if snippets else F.lit(None).cast("string")
    return out.select(
        "article_id", "title", F.coalesce("content", F.lit("")).alias("text"), F.lit("C").alias("type"),
        X.power(F.col("score")).alias("power"), shown(marked, F.col("content")).alias("snippet"), F.col("score"), F.col("doc_id").alias("hit"),
    ).orderBy("score", "hit")


def plain(results: DataFrame) -> DataFrame:
    return results.select(*RESULT_COLUMNS)


def lexical(articles: Index, sections: Index, query: str, limit: int) -> DataFrame:
    """Titles, then contents, fused by article; keeps ``ord`` and ``stage`` out."""
    found = fusion.staged(titles(articles, sections.rows, query, limit), contents(sections, articles.rows, query, limit))
    return fusion.fuse(found, limit)


def nearest_words(vocabulary: DataFrame, word: str, limit: int) -> DataFrame:
    """Edit-distance search: text, power (the distance), nearest first."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    distance = F.levenshtein(F.col("term"), F.lit(word)).cast("double")
    return vocabulary.select("term").distinct().select(F.col("term").alias("text"), distance.alias("power")).orderBy("power", "text").limit(limit)
