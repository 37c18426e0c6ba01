"""Streaming ingest: new record files become articles, sections and postings.

The reference has no streams; this extends the batch import to a folder that
JSON-lines files arrive in.  Lines count as they stand in their file.  A batch is
one commit, which also notes the batch's number, so a replayed batch changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Engine
from ..sources import archive


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of arriving files, as archive, member, block (of the file), value."""
    text = spark.readStream.format("text").load(folder)
    return text.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_name").alias("member"), F.col("_metadata.file_block_start").alias("block"), "value")


def ordered(batch: DataFrame) -> DataFrame:
    """Adds ``line``, a line's number in its file: one task reads a block from start to end,
    so its rows' running ids are in order, and blocks are ordered by where they start."""
    place = Window.partitionBy("archive", "member").orderBy("block", "_id")
    return batch.withColumn("_id", F.monotonically_increasing_id()).withColumn("line", F.row_number().over(place).cast("long")).drop("_id", "block")


def run(engine: Engine, folder: str, checkpoint: str, reindex: bool = True) -> StreamingQuery:
    """Ingest what is there, then stop (a trigger of all that is available).

    A batch appends its sections.  With ``reindex`` replaced sections go and the indexes
    are built anew after each batch, from all articles; for a large store leave it out
    and call ``optimize`` and ``build_index`` when the files are in."""
    mark = f"stream:{checkpoint}"

    def upsert(batch: DataFrame, number: int) -> None:
        if number > engine.mark(mark, -1):
            pages = archive.with_sections(archive.articles(ordered(batch))).persist()
            engine.put_articles(pages, {mark: number})
            pages.unpersist()
        if reindex:
            engine.optimize()
            engine.build_index()

    stream = records(engine.spark, folder)
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
