"""A training-data pipeline over ``documents``: five stages in a row.

Each stage takes all rows that its predecessor kept and, but for the last,
returns them with the columns of documents.  ``ORACLE_SQL`` is None: voting among
neighbours and online regression have no SQL; the tests hold ``run`` against a
brute-force version.

Defined cases, of every stage: null doc_ids and texts, empty and very long texts are
judged like any others and pass unless a stage says otherwise; a null text is never a
copy; an empty table gives none; rows keep all their columns, null or not and whatever
their names, until packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillsearch.llm import exact, packing, quality, simhash, tools, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1.  Rows that score below the threshold go; equal texts fare alike.

    A null or empty text has no direction and scores the share of good labels, so it stays
    where most labels are good; without labels all rows stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7.  Toxic rows go; equal texts fare alike, and without labels all rows stay.

    A null or empty text is judged by the bias alone."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4.  Of equal texts one row stays: the least doc_id's, nulls last.

    Of several such rows one stays, by a hash of all columns; every null text stays."""
    return tools.keep_rows(docs, exact.groups(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3.  Of each group of near copies one row stays: the least doc_id's, nulls last.

    Groups whose ids are repeated or null keep a row each; every null text stays."""
    return tools.keep_rows(docs, simhash.groups(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2.  Columns doc_id, n_tokens, bucket, batch: one row per row, repeated ones too.

    Null and empty texts have length 0; a text beyond the budget is a batch of its own."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    The tables go to the shared folder in spark.checkpoint.dir."""
    folder = f"{tools.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
