"""Exact dedup by progressive refinement.

Texts are grouped by byte length, then by the hash of a prefix, and only texts
whose group still has more than one member are hashed in full (SHA-256).  Texts
are never moved: the length and prefix pass moves three longs a document.  The
surviving keys are broadcast; where they are too many for that a Bloom filter of
bounded size stands for them, so that some others may be hashed too, and digests
settle all.  Clusters are aggregated before they meet their rows, so that no task
gathers the copies of one text.

Defined cases: null texts are no copies of each other, each is its own group;
empty texts are copies; texts of any length are hashed whole; a group is named by
its least doc_id (nulls last), and the first row of that id is kept; rows without
doc_id in a group of their own have a null group_id, and groups that share their
least doc_id share its name, but each keeps one row; repeated rows are copies; an
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tools
from .tools import cut, text_key

#: Characters of the prefix that the second round hashes.
PREFIX = 64


def groups(documents: DataFrame, keyed: bool = True) -> DataFrame:
    """Columns doc_id, group_id, copies, keep: one row per row of documents.

    If keyed, text_key too, by which ``tools.keep_rows`` finds the rows again."""
    key = [text_key(F.col("text")).alias("text_key")] if keyed else []
    also = ["text_key"] if keyed else []
    length, prefix = F.octet_length("text").alias("size"), F.xxhash64(F.substring("text", 1, PREFIX)).alias("prefix")
    narrow = cut(documents.select("doc_id", F.col("text").isNull().alias("missing"), length, prefix, *key))
    # one shuffle serves both rounds: the prefix round only splits groups of one length
    by_size = narrow.where("not missing").groupBy("size", "prefix").agg(F.count("*").alias("n"))
    lengths = by_size.withColumn("all", F.sum("n").over(Window.partitionBy("size"))).where("all > 1")
    keys = cut(lengths.where("n > 1").select("size", "prefix"))
    n = keys.count()
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", length, prefix, *key)
    if n <= tools.BROADCAST_ROWS:
        left = texts.join(F.broadcast(keys), ["size", "prefix"], "left_semi")
        single = narrow.join(F.broadcast(keys), ["size", "prefix"], "left_anti")
    else:
        maybe = tools.key_filter(keys.select(F.xxhash64("size", "prefix").alias("hash")), n)
        left = texts.where(maybe(F.xxhash64("size", "prefix")))
        single = narrow.where(F.col("missing") | ~maybe(F.xxhash64("size", "prefix")))
    full = cut(left.select("doc_id", "size", F.unhex(F.sha2(F.encode("text", "utf-8"), 256)).alias("hash"), F.monotonically_increasing_id().alias("row"), *also))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    clusters = full.groupBy("size", "hash").agg(first, F.count("*").alias("copies")).where("copies > 1")
    met = full.join(tools.checked_broadcast(clusters, 4), ["size", "hash"], "left")
    copies = met.select(
        "doc_id",
        F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("group_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
        (F.col("copies").isNull() | (F.col("row") == F.col("first.row"))).alias("keep"),
        *also,
    )
    return copies.unionByName(single.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("copies"), F.lit(True).alias("keep"), *also))


ORACLE = """
SELECT doc_id,
       CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS group_id,
       CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS copies,
       text IS NULL OR row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) = 1 AS keep
FROM documents
"""
