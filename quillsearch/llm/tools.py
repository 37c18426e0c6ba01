"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: the session's ``spark.checkpoint.dir``.

    Only a session in one process (tests) may leave it unset and gets a temporary one."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="shared-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    The files outlive executors; ``spark.cleaner.referenceTracking.cleanCheckpoints``
    lets Spark remove those that are no longer used."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores until no column of df clashes (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def over_text(df: DataFrame, schema: T.StructType | str, work: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict], text: str = "text", also: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Map slices of a text column to rows.

    ``work(raw, at, batch)`` gets the bytes and offsets of a slice of texts and
    the slice itself, and returns the columns of ``schema``.  Only the text and
    the columns named are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = kernels.as_large(batch.column(text))
            raw, at = kernels.buffers(column)
            for a, b in kernels.slices(np.diff(at)):
                out = work(raw[at[a] : at[b]], at[a : b + 1] - at[a], batch.slice(a, b - a))
                yield pa.RecordBatch.from_pydict(out)

    return df.select(text, *also).mapInArrow(run, schema)


#: A side of up to so many narrow rows (some tens of MB) is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, share: int = 1) -> DataFrame:
    """Cut df, count it, and mark it for broadcast only if it is small.

    ``share`` divides the bound where rows are wider."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= BROADCAST_ROWS // share else done


#: Most bits of a key filter (16 MB); with more keys than a tenth of it, it lets more pass.
FILTER_BITS = 1 << 27


def key_filter(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A Bloom filter (two places a key) of the n values of the long column ``hash``.

    It is made in tasks; at most FILTER_BITS come to the driver and go out again.  The
    returned function tells of a column of hashes whether each may be among them."""
    bits = min(FILTER_BITS, 1 << max(16, (16 * n).bit_length()))
    mask = bits - 1
    place = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(mask))))
    words = hashes.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    got = words.toArrow()
    table = np.zeros(bits >> 6, dtype=np.uint64)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    shared = hashes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def maybe(hash: pd.Series) -> pd.Series:
        h = hash.to_numpy(dtype=np.int64).view(np.uint64)
        out = np.ones(len(h), dtype=bool)
        for at in (h & np.uint64(mask), (h >> np.uint64(32)) & np.uint64(mask)):
            out &= (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(out)

    return maybe


def text_key(text: Column) -> Column:
    """Half of a text's SHA-256, as 16 bytes: with the doc_id it says which row a decision is for."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


def keep_rows(documents: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of documents that ``judged`` (doc_id, text_key, keep) keeps, with their columns.

    What goes is usually the smaller side, so only that is joined.  Of rows equal in
    doc_id and text as many stay as are kept, the first by a hash of all their columns."""
    ids = judged.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"), F.sum(F.col("keep").cast("int")).alias("kept"))
    odd = cut(ids.where("kept < rows"))
    gone = odd.where("kept = 0")
    some = odd.where("kept > 0")
    n = odd.count()
    mark = (lambda x: F.broadcast(x)) if n <= BROADCAST_ROWS else (lambda x: x)
    own, key, text, kept, rank = fresh(documents, "own_key", "some_id", "some_key", "kept_rows", "row_rank")
    left = documents.withColumn(own, text_key(F.col("text")))

    def named(side: DataFrame) -> DataFrame:
        return mark(side.select(F.col("doc_id").alias(key), F.col("text_key").alias(text), F.col("kept").alias(kept)))

    match = F.col("doc_id").eqNullSafe(F.col(key)) & F.col(own).eqNullSafe(F.col(text))
    left = left.join(named(gone), match, "left_anti")
    if not some.isEmpty():
        whole = left.join(named(some), match, "left_anti")
        # maps can't be hashed
        columns = [f.name for f in documents.schema.fields if "map<" not in f.dataType.simpleString()]
        order = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
        ranked = left.join(named(some), match).withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", own).orderBy(order)))
        left = whole.unionByName(ranked.where(F.col(rank) <= F.col(kept)).drop(key, text, kept, rank))
    return left.drop(own)
