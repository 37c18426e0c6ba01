"""Packing: optimal length buckets and token-budget batches.

A document's length is its number of runs of non-blank characters.  The global
histogram of lengths goes to the driver (a row per distinct length), where a
dynamic program chooses the ``BUCKETS`` upper bounds that minimise total padding;
divide and conquer over the monotone leftmost optimum makes it
O(buckets * lengths * log lengths).  Inside a bucket documents are ranked by
(length, shard, doc_id) and cut into batches of ``max(1, budget // bound)``.
Ranks come from counts per (length, shard) plus a rank within, so no task ever
holds a whole bucket.

Defined cases: null, empty and blank texts have length 0 and are packed too; a
text longer than the budget is a batch of its own; with fewer distinct lengths
than buckets each length is a bucket; equal padding is settled toward the
smaller bounds; repeated rows are packed each; null doc_ids rank last; an empty
table gives no rows; other columns, whatever their names, are not read.  Text without
blanks counts as one, whatever its size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tools
from .tools import cut

BUCKETS = 8
TOKEN_BUDGET = 16384
SHARDS = 64
BLANK = r"[^ \t\n\r\f]+"


def bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, of the least total padding; lengths ascending."""
    m = len(lengths)
    if m == 0:
        return []
    k = min(buckets, m)
    size = np.asarray(lengths, dtype=np.int64)
    c = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.int64))])
    s = np.concatenate([[0], np.cumsum(size * np.asarray(counts, dtype=np.int64))])
    huge = np.iinfo(np.int64).max // 4
    best = np.full(m + 1, huge, dtype=np.int64)
    best[0] = 0
    choice = np.zeros((k + 1, m + 1), dtype=np.int64)
    for layer in range(1, k + 1):
        now = np.full(m + 1, huge, dtype=np.int64)
        todo = [(layer, m, layer - 1, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            cost = best[i] + size[j - 1] * (c[j] - c[i]) - (s[j] - s[i])
            at = int(cost.argmin())
            now[j], choice[layer, j] = cost[at], i[at]
            todo += [(lo, j - 1, left, int(i[at])), (j + 1, hi, int(i[at]), right)]
        best = now
    out, j = [], m
    for layer in range(k, 0, -1):
        out.append(int(size[j - 1]))
        j = int(choice[layer, j])
    return out[::-1]


def pack(documents: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Columns doc_id, n_tokens, bucket (its bound), batch: one row per row of documents."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(BLANK)), F.lit(0)).cast("long")
    shard = F.coalesce(F.pmod(F.col("doc_id"), F.lit(SHARDS)), F.lit(0)).cast("int")
    rows = cut(documents.select("doc_id", tokens.alias("n_tokens"), shard.alias("shard")))
    cells = cut(rows.groupBy("n_tokens", "shard").agg(F.count("*").alias("n")))
    histogram = cells.groupBy("n_tokens").agg(F.sum("n").alias("n")).orderBy("n_tokens").toPandas()
    edge = bounds(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), buckets)
    if not edge:
        return rows.select("doc_id", "n_tokens", F.col("n_tokens").alias("bucket"), F.lit(0).cast("long").alias("batch"))
    bucket = F.lit(edge[-1])
    for bound in reversed(edge[:-1]):
        bucket = F.when(F.col("n_tokens") <= bound, F.lit(bound)).otherwise(bucket)
    before = Window.partitionBy("bucket").orderBy("n_tokens", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("bucket", bucket.cast("long")).select("n_tokens", "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if len(histogram) * SHARDS <= tools.BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    rank = F.row_number().over(Window.partitionBy("n_tokens", "shard").orderBy(F.col("doc_id").asc_nulls_last()))
    ranked = rows.withColumn("rank", rank).join(offsets, ["n_tokens", "shard"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1)))).cast("long")
    return ranked.select("doc_id", "n_tokens", "bucket", F.floor((F.col("before") + F.col("rank") - 1) / room).cast("long").alias("batch"))


def oracle(buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, table: str = "documents") -> str:
    """The same rows in DuckDB SQL, the dynamic program as a chain of subqueries."""
    layers = ["f1 AS (SELECT j, l * c - s AS v, 0::BIGINT AS i FROM h)"]
    for k in range(2, buckets + 1):
        layers.append(f"f{k} AS (SELECT j, m[1] AS v, m[2] AS i FROM (SELECT h.j, min([f.v + h.l * (h.c - p.c) - (h.s - p.s), p.j]) AS m FROM h JOIN h p ON p.j < h.j JOIN f{k - 1} f ON f.j = p.j GROUP BY h.j))")
    # with fewer lengths than buckets the last feasible layer is the number of lengths
    back = [f"b{buckets} AS (SELECT max(j) AS j FROM h WHERE (SELECT count(*) FROM h) >= {buckets})"]
    for k in range(buckets, 1, -1):
        back.append(f"b{k - 1} AS (SELECT i AS j FROM f{k} WHERE j = (SELECT j FROM b{k}) UNION ALL SELECT max(j) FROM h HAVING count(*) = {k - 1})")
    ends = " UNION ".join(f"SELECT j FROM b{k}" for k in range(1, buckets + 1))
    return f"""
WITH r AS MATERIALIZED (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)::BIGINT AS n_tokens, coalesce(((doc_id % {SHARDS}) + {SHARDS}) % {SHARDS}, 0) AS shard FROM {table}),
g AS (SELECT n_tokens AS l, count(*) AS n FROM r GROUP BY 1),
h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l) AS j, l, (sum(n) OVER (ORDER BY l))::BIGINT AS c, (sum(n * l) OVER (ORDER BY l))::BIGINT AS s FROM g),
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in layers)},
{", ".join(x.replace(" AS (", " AS MATERIALIZED (", 1) for x in back)},
e AS (SELECT l FROM h WHERE j IN (SELECT j FROM ({ends}) WHERE j IS NOT NULL)),
a AS (SELECT r.*, (SELECT min(l) FROM e WHERE l >= r.n_tokens) AS bucket FROM r)
SELECT doc_id, n_tokens, bucket, ((row_number() OVER (PARTITION BY bucket ORDER BY n_tokens, shard, doc_id NULLS LAST) - 1) // greatest(1, {budget} // greatest(bucket, 1)))::BIGINT AS batch FROM a
"""
