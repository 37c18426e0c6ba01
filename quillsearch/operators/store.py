"""The stored engine: Parquet tables under one folder, and all searches on them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as X
from ..sources import archive
from ..sources.folder import Folder
from . import fusion, index, ivf, search

PERSISTED = ("aiModel", "aiModelPrefixSave", "aiModelPrefixSearch", "aiAnnSize", "language")


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the last by the order."""
    (rank,) = ["_rank"]
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def newest_ids(rows: DataFrame, keys: Sequence[str], id: str = "id") -> DataFrame:
    """The keys with the greatest id of each: MAX(id) ... GROUP BY keys."""
    return rows.groupBy(*keys).agg(F.max(id).alias(id))


def next_id(rows: DataFrame, id: str = "id") -> int:
    """One more than the greatest id; 1 for an empty table."""
    return rows.agg((F.coalesce(F.max(id), F.lit(0)) + 1).alias("next")).first()["next"]


def nonempty(rows: DataFrame, column: str) -> DataFrame:
    """n: how many rows have something in the column."""
    return rows.where(F.col(column).isNotNull() & (F.length(column) > 0)).agg(F.count("*").alias("n"))


#: Ids of up to so many rows are broadcast.
BROADCAST_IDS = 1_000_000


def dedup_sections(sections: DataFrame) -> DataFrame:
    """The section of highest id for each (article_id, title).

    Only ids and titles are shuffled; the ids that go are then taken out of the rows,
    by broadcast if they are few."""
    same = Window.partitionBy("article_id", "title").orderBy(F.desc("id"))
    gone = sections.select("id", "article_id", "title").withColumn("_rank", F.row_number().over(same)).where("_rank > 1").select("id")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return sections.join(F.broadcast(gone) if few else gone, "id", "left_anti")


#: Tasks that share a bucket of the index, at least.
SHARDS = 4


def owned(sections: DataFrame, articles: DataFrame) -> DataFrame:
    """Sections with ``owned``: whether their article is there.

    Only ids are shuffled; those of missing articles are joined to the sections, by
    broadcast if they are few."""
    lost = sections.select("article_id").distinct().join(articles.select(F.col("id").alias("article_id")), "article_id", "left_anti")
    lost = lost.where("article_id IS NOT NULL").withColumn("_lost", F.lit(True))
    few = lost.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    told = sections.join(F.broadcast(lost) if few else lost, "article_id", "left")
    return told.withColumn("owned", F.col("article_id").isNotNull() & F.col("_lost").isNull()).drop("_lost")


def compressed(sections: DataFrame) -> DataFrame:
    """Contents deflated where that is smaller; then the content is null."""
    z = sections.withColumn("_z", X.deflate(F.when(F.length("content") > 0, F.col("content"))))
    small = F.length("_z") < F.octet_length("content")
    return z.withColumn("content_flate", F.when(small, F.col("_z")).otherwise(F.col("content_flate"))).withColumn("content", F.when(small, None).otherwise(F.col("content"))).drop("_z")


readable = search.opened


def embedding_text(sections: DataFrame, articles: DataFrame, prefix: str = "") -> DataFrame:
    """id, input: what is embedded for each section that has an article."""
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"))
    joined = sections.join(a, "article_id")
    return joined.select("id", F.concat(F.lit(prefix), "article_title", F.lit(" - "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("input"))


def pending(sections: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sections without a vector."""
    return sections.join(vectors.select("id"), "id", "left_anti")


def article(articles: DataFrame, sections: DataFrame, article_id: int) -> DataFrame:
    """One nested row, or none when the article has no sections."""
    a = articles.where(F.col("id") == article_id).select("id", "title", "entity")
    s = sections.where(F.col("article_id") == article_id).select("article_id", F.struct("id", "title", "content").alias("s"))
    return a.join(s, a["id"] == F.col("article_id")).groupBy("id", "title", "entity").agg(F.array_sort(F.collect_list("s")).alias("sections"))


class Engine:
    """A folder of tables, local or shared.

    A manifest names the folders that each table consists of.  Tables are written
    whole under new names and appear together with the next manifest, so readers see
    all of a change or nothing.  There is one writer at a time: a second one that
    commits meanwhile fails, because the manifest's number is taken."""

    def __init__(self, spark: SparkSession, path: str, writable: bool = True):
        self.spark, self.path, self.writable = spark, path.rstrip("/"), writable
        self.folder = Folder(path)
        if writable:
            self.folder.make()

    @classmethod
    def open(cls, spark: SparkSession, path: str, writable: bool | None = None) -> Engine:
        """Read-only unless asked for or nothing is there yet."""
        return cls(spark, path, not Folder(path).exists() if writable is None else writable)

    # tables
    def _manifests(self) -> list[str]:
        return [n for n in self.folder.names() if n.startswith("manifest-")]

    def _manifest(self) -> tuple[int, dict]:
        """The newest manifest's number, and its tables and marks."""
        names = self._manifests()
        if not names:
            return 0, {"tables": {}, "marks": {}}
        return int(names[-1][9:21]), json.loads(self.folder.read(names[-1]))

    def has(self, name: str) -> bool:
        return name in self._manifest()[1]["tables"]

    def mark(self, name: str, default=None):
        """A small value that was committed with the tables."""
        return self._manifest()[1]["marks"].get(name, default)

    def table(self, name: str, schema=None) -> DataFrame:
        parts = self._manifest()[1]["tables"].get(name)
        if parts:
            return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])
        if schema is None:
            raise LookupError(f"there is no table {name}")
        return self.spark.createDataFrame([], schema)

    def save(self, name: str, rows: DataFrame, partition: str | None = None) -> str:
        """Write rows under a new name, which no reader sees before it is committed."""
        if not self.writable:
            raise PermissionError("the store is read-only")
        version = f"{name}-{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/{version}")
        return version

    def commit(self, tables: dict[str, DataFrame | str], more: dict[str, DataFrame | str] | None = None, marks: dict | None = None) -> None:
        """Replace ``tables`` and append to ``more``, rows or what was saved, all in one step."""
        if not self.writable:
            raise PermissionError("the store is read-only")
        number, now = self._manifest()
        for name, rows in (tables | (more or {})).items():
            version = rows if isinstance(rows, str) else self.save(name, rows)
            now["tables"][name] = [*(now["tables"].get(name, []) if name not in tables else []), version]
        now["marks"] |= marks or {}
        self.folder.put(f"manifest-{number + 1:012d}.json", json.dumps(now).encode())

    def write(self, name: str, rows: DataFrame, partition: str | None = None) -> None:
        self.commit({name: self.save(name, rows, partition)})

    def vacuum(self, keep: int = 2) -> int:
        """Remove what only older manifests than the last ``keep`` name; returns how many folders.

        Readers of a kept manifest go on undisturbed."""
        if not self.writable:
            raise PermissionError("the store is read-only")
        names = self._manifests()
        old, kept = names[:-keep], names[-keep:]
        folders = {n: {p for parts in json.loads(self.folder.read(n))["tables"].values() for p in parts} for n in names}
        live = set().union(*(folders[n] for n in kept)) if kept else set()
        gone = set().union(*(folders[n] for n in old)) - live if old else set()
        there = set(self.folder.names())
        # manifests go last, so that an interrupted run can be taken up again
        for name in [*sorted(gone & there), *old]:
            self.folder.drop(name)
        return len(gone & there)

    @property
    def articles(self) -> DataFrame:
        return self.table("articles", S.ARTICLES)

    @property
    def sections(self) -> DataFrame:
        return readable(self.table("sections", S.SECTIONS))

    # settings
    def put(self, key: str, value: bytes | str) -> None:
        self.write("setup", self._with(key, value))

    def _with(self, key: str, value: bytes | str) -> DataFrame:
        """The settings with one set."""
        data = value.encode() if isinstance(value, str) else value
        new = self.spark.createDataFrame([(key, bytearray(data))], S.SETUP)
        return self.table("setup", S.SETUP).where(F.col("key") != key).unionByName(new).coalesce(1)

    def get(self, key: str) -> bytes:
        row = self.table("setup", S.SETUP).where(F.col("key") == key).limit(1).first()
        if row is None:
            raise KeyError(key)
        return bytes(row["value"])

    # ingest
    def put_articles(self, pages: DataFrame, marks: dict | None = None) -> None:
        """Upsert articles by id in order of arrival and append their sections, in one commit.

        ``pages`` has id, title, entity, items, archive, member, line."""
        order = [F.desc("archive"), F.desc("member"), F.desc("line")]
        newest = last_wins(pages.select("id", "title", "entity", "archive", "member", "line"), ["id"], order).select("id", "title", "entity")
        known = self.articles.join(newest.select("id"), "id", "left_anti")
        last = next_id(self.table("sections", S.SECTIONS)) - 1
        flat = pages.select("id", "archive", "member", "line", F.posexplode("items").alias("place", "item"))
        # surrogate keys follow the order of arrival
        keyed = numbered(flat, ["archive", "member"], ["line", "place"], last)
        rows = keyed.select(F.col("key").alias("id"), F.col("id").alias("article_id"), "item.title", "item.content", F.lit(None).cast("binary").alias("content_flate"), "item.pow")
        self.commit({"articles": known.unionByName(newest)}, {"sections": rows}, marks=marks)

    def ingest(self, path: str, language: str = "en") -> None:
        """Import archives: sections, settings, dedup, indexes and vocabulary."""
        if path.startswith(("http://", "https://")):
            name = f"download-{uuid.uuid4().hex}.tar.gz"
            with self.folder.sink(name) as (out, _):
                archive.download(path, out)
            path = f"{self.path}/{name}"
        pages = archive.with_sections(archive.articles(archive.read_archives(self.spark, path))).persist()
        self.put_articles(pages)
        pages.unpersist()
        self.put("language", language)
        self.optimize()
        self.build_index()

    def optimize(self) -> None:
        """Drop sections that newer ones replace, and what no manifest needs."""
        self.write("sections", dedup_sections(self.table("sections", S.SECTIONS)))
        self.vacuum()

    def build_index(self, buckets: int | None = None) -> None:
        """Rebuild both indexes in one pass over each table; again, it changes nothing.

        Postings lie in files by term bucket, sorted by term, so a query reads the
        buckets of its words and in them the row groups of its terms.  A bucket's rows
        are shared out by document among several tasks, however many buckets there are, so
        that a common word is no task's alone.  Each posting has its row's length and whether
        the row has an article, and a posting of the empty term stands for every row."""
        sections = self.table("sections", S.SECTIONS)
        count = sections.count()
        buckets = buckets or min(4096, max(8, count // 20_000))
        shards = max(SHARDS, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // buckets)
        new = {}
        for name, rows, columns in (("title", self.articles.withColumn("owned", F.lit(True)), ["title"]), ("content", readable(owned(sections, self.articles)), ["title", "content"])):
            post = index.stored(rows, "id", columns, "owned").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
            task = (F.col("bucket") * shards + F.pmod(F.xxhash64(F.get("doc_id", F.lit(0))), F.lit(shards))).cast("int")
            new[f"{name}_postings"] = self.save(f"{name}_postings", post.repartitionById(buckets * shards, task).sortWithinPartitions("bucket", "term"), "bucket")
        posts = {n: self.spark.read.parquet(f"{self.path}/{new[f'{n}_postings']}") for n in ("title", "content")}
        sizes = {n: index.stored_corpus(p).first().asDict() for n, p in posts.items()}
        self.commit(new | {"vocabulary": index.vocabulary(*posts.values()).where("term <> ''")}, marks={"buckets": buckets, "corpus": sizes})

    def compress(self) -> None:
        self.write("sections", compressed(self.table("sections", S.SECTIONS)))

    # searches
    def _index(self, name: str, rows: DataFrame, columns: list[str], query: str) -> search.Index:
        terms = sorted({t for p in X.phrases(query) for t in p})
        post = self.table(f"{name}_postings")
        # the buckets of the words, as xxhash64 tells them
        signed = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in terms]
        buckets = sorted({(h - (1 << 64) if h >> 63 else h) % self.mark("buckets") for h in signed})
        post = index.unfolded(post.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket"))
        return search.Index(rows, "id", columns, (post, self.mark("corpus")[name]))

    def title_index(self, query: str) -> search.Index:
        return self._index("title", self.articles, ["title"], query)

    def content_index(self, query: str) -> search.Index:
        return self._index("content", self.table("sections", S.SECTIONS), ["title", "content"], query)

    def search_title(self, query: str, limit: int = 10) -> DataFrame:
        return search.plain(search.titles(self.title_index(query), self.table("sections", S.SECTIONS), query, limit))

    def search_content(self, query: str, limit: int = 10) -> DataFrame:
        return search.plain(search.contents(self.content_index(query), self.articles, query, limit))

    def search_lexical(self, query: str, limit: int = 10) -> DataFrame:
        return search.plain(search.lexical(self.title_index(query), self.content_index(query), query, limit))

    def search_distance(self, word: str, limit: int = 10) -> DataFrame:
        found = search.nearest_words(self.table("vocabulary", S.VOCABULARY), word, limit)
        return found.select(F.lit(0).cast("long").alias("article_id"), F.lit("").alias("title"), "text", F.lit("").alias("type"), "power", F.lit("").alias("snippet"))

    def _semantic(self, vector: Sequence[float], limit: int) -> DataFrame:
        vectors = self.table("vectors") if self.has("vectors") else None
        ann = self.table("ann") if self.has("ann") else None
        centroids = self.table("centroids") if self.has("centroids") else self.spark.createDataFrame([], S.CENTROIDS)
        size = int(self.get("aiAnnSize")) if ann is not None else 64
        return ivf.semantic(self.table("sections", S.SECTIONS), self.articles, vector, limit, vectors, ann, centroids, size)

    def search_semantic(self, vector: Sequence[float], limit: int = 10) -> DataFrame:
        return search.plain(self._semantic(vector, limit))

    def search(self, query: str, limit: int = 10, vector: Sequence[float] | None = None) -> DataFrame:
        """Lexical results, cut; then semantic ones appended, fused and cut again."""
        found = search.lexical(self.title_index(query), self.content_index(query), query, limit)
        if vector is not None:
            found = fusion.refuse(found, self._semantic(vector, limit), limit)
        return search.plain(found)

    def article(self, article_id: int) -> dict:
        row = article(self.articles, self.sections, article_id).first()
        if row is None:
            raise LookupError("article not found")
        return row.asDict(recursive=True)

    # vectors
    def sync_vectors(self, embed: Callable[[DataFrame], DataFrame], prefix: str = "", ann: bool = False, ann_size: int = 64) -> None:
        """Embed what has no vector yet; ``embed`` maps (id, input) to (id, embedding, error)."""
        have = self.table("vectors", S.VECTORS)
        todo = pending(self.sections, have)
        done = embed(embedding_text(todo, self.articles, prefix)).persist()
        fine = done.where("error is null").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
        self.write("vectors", have.unionByName(fine))
        self.write("vector_failures", done.where("error is not null").select("id", "error"))
        done.unpersist()
        if ann:
            self.build_ann(ann_size)

    def build_ann(self, size: int = 64, cell: int = ivf.CELL) -> None:
        short = ivf.truncated(self.table("vectors", S.VECTORS), size)
        if short.isEmpty():
            raise ValueError("there are no vectors")
        centroids, cells = ivf.kmeans(short, cell)
        lists = ivf.layout(cells, cell).withColumn("bucket", ivf.bucket(F.col("centroid_id")))
        saved = self.save("ann", lists.repartition("centroid_id").sortWithinPartitions("bucket", "centroid_id", "chunk_id", "pos"), "bucket")
        rows = self.spark.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(centroids)], S.CENTROIDS)
        self.commit({"ann": saved, "centroids": rows, "setup": self._with("aiAnnSize", str(size))})


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str], start: int = 0) -> DataFrame:
    """Adds ``key``: start + 1, start + 2, … by the groups, then the order inside.

    A count per group and a rank inside it: the only window over all groups sees
    a row for each."""
    counts = rows.groupBy(*groups).count()
    before = counts.select(*groups, (F.sum("count").over(Window.orderBy(*groups)) - F.col("count")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("_rank", rank).join(before, list(groups)).withColumn("key", (F.lit(start) + F.col("_before") + F.col("_rank")).cast("long")).drop("_rank", "_before")
