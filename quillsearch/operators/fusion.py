"""Rank fusion by article, with noisy-OR powers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def staged(*results: DataFrame) -> DataFrame:
    """Result lists one after another: ``ord`` is (stage, rank in it).

    The lists are top-k results, so the window holds some rows only."""
    out = []
    for stage, rows in enumerate(results):
        rank = F.row_number().over(Window.partitionBy(F.lit(stage)).orderBy("score", "hit"))
        out.append(rows.select("article_id", "title", "text", "type", "power", "snippet", F.struct(F.lit(stage).alias("stage"), rank.alias("rank")).alias("ord")))
    return reduce(DataFrame.unionByName, out)


def fuse(results: DataFrame, limit: int) -> DataFrame:
    """One row per article: the first row's fields and all powers, p + q - pq/100
    in order of arrival; best first, then first come."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    powers = F.transform(F.array_sort(F.collect_list(F.struct("ord", "power"))), lambda x: x["power"])
    joined = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x - a * x / 100)
    first = F.min_by(F.struct("title", "text", "type", "snippet"), "ord")
    rows = results.groupBy("article_id").agg(first.alias("f"), joined.alias("power"), F.min("ord").alias("ord"))
    rows = rows.select("article_id", "f.title", "f.text", "f.type", F.round("power", 6).alias("power"), "f.snippet", "ord")
    return rows.orderBy(F.desc("power"), "ord").limit(limit)


def refuse(kept: DataFrame, more: DataFrame, limit: int) -> DataFrame:
    """Append a further list to fused rows and fuse again, after the first cut."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("power"), "ord"))
    first = kept.withColumn("ord", F.struct(F.lit(0).alias("stage"), rank.alias("rank")))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("score", "hit"))
    second = more.select("article_id", "title", "text", "type", "power", "snippet", F.struct(F.lit(1).alias("stage"), rank.alias("rank")).alias("ord"))
    return fuse(first.unionByName(second), limit)
