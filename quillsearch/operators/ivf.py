"""Clustered approximate vector search: spherical k-means and inverted lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

CELL = 2500
ROUNDS = 10
#: At least so many cells' worth of vectors are probed.
FLOOR_CELLS = 50
#: Folders that the cells of a stored layout are spread over.
BUCKETS = 256
#: Similarities that a task has in hand at once (32 MiB), one row's at least.
SCORES = 1 << 22
#: Largest matrix of centroids that is broadcast.
MOST_BYTES = 1 << 30


def similar(vectors: DataFrame, query, limit: int, column: str = "embedding") -> DataFrame:
    """id, sim: the most similar vectors by dot product; ids settle ties."""
    return vectors.select("id", F.round(V.dot(F.col(column), V.literal(query)), 9).alias("sim")).orderBy(F.desc("sim"), "id").limit(limit)


def truncated(vectors: DataFrame, size: int) -> DataFrame:
    return vectors.select("id", V.truncate(F.col("embedding"), size).alias("embedding"))


def numbered(vectors: DataFrame) -> DataFrame:
    """Rows with ``row``, their 0-based place by id, without a single-task sort.

    Ids are cut into ranges of equal width, told by the id alone, so that they are the
    same whenever they are computed; a range's rows are ranked and follow the counts
    of the ranges before."""
    parts = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edge = vectors.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    low, width = edge["low"] or 0, max(1, -(-((edge["high"] or 0) - (edge["low"] or 0) + 1) // parts))
    spread = vectors.withColumn("part", F.floor((F.col("id") - low) / width).cast("long"))
    counts = spread.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id")).cast("long")
    return spread.join(F.broadcast(before), "part").withColumn("row", F.col("before") + rank - 1).drop("part", "before")


def nearest(x: np.ndarray, centroids: np.ndarray, most: int = SCORES) -> np.ndarray:
    """The row of the most similar centroid for each vector, the lowest of equals.

    Vectors are taken so few at a time that their similarities to all centroids stay
    within ``most``, however many centroids there are."""
    step = max(1, most // max(1, len(centroids)))
    best = [(x[at : at + step] @ centroids.T).argmax(axis=1) for at in range(0, len(x), step)]
    return np.concatenate(best) if best else np.zeros(0, dtype=np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, without an object for each."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) % len(column) or (column.value_lengths().to_numpy(zero_copy_only=False) != len(flat) // len(column)).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, centroid_id (from 1), embedding: each vector's most similar centroid, the
    lowest of equals.  Blocks of vectors meet all centroids in numpy; a block is
    smaller where there are more centroids."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = nearest(matrix(batch.column("embedding")), shared.value) + 1
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), batch.column("embedding")], ["id", "centroid_id", "embedding"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, centroid_id int, embedding array<double>")


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=x.copy(), where=size > 0)


def kmeans(vectors: DataFrame, cell: int = CELL, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Centroids after the last update, and the last round's assignment.

    Seeds are evenly spaced rows by id; an empty cell takes row 7i mod N.  Only
    partial sums, a row per cell and task, leave the executors."""
    rows = numbered(vectors).persist()
    n = rows.count()
    if n == 0:
        raise ValueError("there are no vectors")
    k = max(1, n // cell)
    size = len(vectors.first()["embedding"])
    if k * size * 8 > MOST_BYTES:
        raise ValueError(f"{k} cells of {size} dimensions are too many to broadcast: make cells larger")
    # row numbers repeat when there are fewer rows than places
    seeds = [i * n // k for i in range(k)]
    spare = [7 * i % n for i in range(k)]
    wanted = vectors.sparkSession.createDataFrame(pd.DataFrame({"row": sorted({*seeds, *spare})}), "row long")
    picked = {r["row"]: np.array(r["embedding"], dtype=np.float64) for r in rows.join(F.broadcast(wanted), "row", "left_semi").select("row", "embedding").toLocalIterator()}
    # centroids are what is broadcast anyway, so their row numbers are fewer still
    centroids = np.stack([picked[s] for s in seeds])
    sc = vectors.sparkSession.sparkContext
    for turn in range(rounds):
        shared = sc.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            c = shared.value
            total, count = np.zeros_like(c), np.zeros(len(c), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("embedding"))
                    best = nearest(x, c)
                    np.add.at(total, best, x)
                    count += np.bincount(best, minlength=len(c))
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cell": used.astype(np.int32), "n": count[used], "total": pa.array(list(total[used]), pa.list_(pa.float64()))})

        partial = rows.select("embedding").mapInArrow(sums, "cell int, n long, total array<double>")
        merged = partial.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(size)]).alias("total"))
        if turn == rounds - 1:
            last = centroids
        now = np.zeros_like(centroids)
        filled = set()
        for r in merged.toLocalIterator():
            now[r["cell"]] = r["total"]
            filled.add(r["cell"])
        for i in range(k):
            if i not in filled:
                now[i] = picked[spare[i]]
        centroids = unit_rows(now)
    rows.unpersist()
    return centroids, assigned(vectors, last)


def bucket(centroid_id):
    """The folder of a cell: cells share a bounded number of them."""
    return F.pmod(centroid_id, F.lit(BUCKETS))


def layout(cells: DataFrame, cell: int = CELL) -> DataFrame:
    """section_id, centroid_id, chunk_id, pos, embedding: chunks of a cell by id."""
    place = F.row_number().over(Window.partitionBy("centroid_id").orderBy("id")) - 1
    slots = cells.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / cell))
    chunks = slots.groupBy("centroid_id").agg((F.max("chunk") + 1).alias("chunks"))
    first = chunks.select("centroid_id", (F.sum("chunks").over(Window.orderBy("centroid_id")) - F.col("chunks")).alias("first"))
    return slots.join(F.broadcast(first), "centroid_id").select(
        F.col("id").alias("section_id"), "centroid_id", (F.col("first") + F.col("chunk") + 1).cast("long").alias("chunk_id"), (F.col("place") % cell).cast("int").alias("pos"), "embedding"
    )


def probes(centroids: DataFrame, sizes: DataFrame, query, limit: int, cell: int = CELL, floor_cells: int = FLOOR_CELLS) -> DataFrame:
    """centroid_id: cells by similarity until enough vectors, and two cells, are taken."""
    target = max(limit * cell, floor_cells * cell)
    order = Window.orderBy(F.desc("sim"), "id")
    ranked = centroids.select("id", F.round(V.dot(F.col("centroid"), V.literal(query)), 9).alias("sim")).join(sizes, F.col("id") == F.col("centroid_id"), "left")
    before = F.sum(F.coalesce("n", F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("rank", F.row_number().over(order)).where((F.col("before") < target) | (F.col("rank") <= 2)).select(F.col("id").alias("centroid_id"))


def search(ann: DataFrame, centroids: DataFrame, query, limit: int, cell: int = CELL, floor_cells: int = FLOOR_CELLS) -> DataFrame:
    """id, sim from the probed cells; without centroids, from all."""
    size = len(query)
    if not centroids.isEmpty():
        wanted = [r[0] for r in probes(centroids, ann.groupBy("centroid_id").count().withColumnRenamed("count", "n"), query, limit, cell, floor_cells).collect()]
        # as literals the cells prune the folders and row groups of a stored layout
        if "bucket" in ann.columns:
            ann = ann.where(F.col("bucket").isin(sorted({c % BUCKETS for c in wanted})))
        ann = ann.where(F.col("centroid_id").isin(wanted))
    return similar(ann.select(F.col("section_id").alias("id"), F.slice("embedding", 1, size).alias("embedding")), query, limit)


def affinity(sim):
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (sim + 1) / 2 * 100))


def semantic(sections: DataFrame, articles: DataFrame, query, limit: int, vectors: DataFrame | None = None, ann: DataFrame | None = None, centroids: DataFrame | None = None, ann_size: int = 64, cell: int = CELL, floor_cells: int = FLOOR_CELLS) -> DataFrame:
    """Vector search in its four modes; a hit without a section still gives a row.

    Neither table: nothing.  Vectors: all are compared.  Lists alone: their
    order.  Both: the lists give limit**2 candidates, which full vectors rank."""
    spark = sections.sparkSession
    if limit < 0:
        raise ValueError("limit must not be negative")
    if vectors is None and ann is None:
        hits = spark.createDataFrame([], "id long, sim double")
    elif ann is None:
        hits = similar(vectors, query, limit)
    else:
        short = np.asarray(query[:ann_size], dtype=np.float64)
        short = unit_rows(short[None])[0]
        hits = search(ann, centroids, short, limit if vectors is None else limit * limit, cell, floor_cells)
        if vectors is not None:
            hits = similar(vectors.join(F.broadcast(hits.select("id")), "id", "left_semi"), query, limit)
    from .search import X, opened

    hits = F.broadcast(hits)
    flate = ["content_flate"] if "content_flate" in sections.columns else []
    # hits first: only their contents are inflated
    rows = opened(sections.select("id", "article_id", "content", *flate).join(hits.select("id"), "id", "left_semi"))
    known = hits.join(rows, "id", "left").join(articles.select(F.col("id").alias("article_id"), "title"), "article_id", "left")
    hit = F.col("title").isNotNull()
    text = F.when(hit, F.coalesce("content", F.lit(""))).otherwise(F.lit(""))
    return known.select(
        F.when(hit, F.col("article_id")).otherwise(F.lit(0)).cast("long").alias("article_id"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"), F.lit("V").alias("type"),
        F.round(affinity(F.col("sim")), 6).alias("power"), X.preview(text).alias("snippet"), (-F.col("sim")).alias("score"), F.col("id").alias("hit"),
    ).orderBy("score", "hit")
