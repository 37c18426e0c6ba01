"""Inverted index: postings, document lengths, corpus size and vocabularies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def spread(rows: DataFrame) -> DataFrame:
    """Rows of few files in a partition per core: a small table is often one file, which
    one task would tokenise.  Tables of files enough are left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def tokenised(rows: DataFrame, key: str, columns: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """doc_id, one token array per column (c0, c1, …), and columns as they are; no shuffle."""
    every = dict.fromkeys(c for c in (*columns, *also) if c != key)
    return spread(rows.select(key, *every)).select(F.col(key).alias("doc_id"), *[tokens(F.col(c)).alias(f"c{i}") for i, c in enumerate(columns)], *also)


def placed(i: int):
    """A column's tokens as structs (col, pos, term)."""
    return F.transform(f"c{i}", lambda t, p: F.struct(F.lit(i).cast("tinyint").alias("col"), p.alias("pos"), t.alias("term")))


#: Postings of a stored row at most, so that a batch of rows stays small however common a word is.
CHUNK = 256
#: Tokens that are gathered at once, unless one row has more.
GATHERED = 1 << 20
#: A stored row: a term and its postings in some rows of the table; ``told`` has len, owned, col
#: and pos + 1 of each in 31, 1, 3 and 29 bits.
FOLDED = "doc_id array<long>, told array<long>, term string"


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, as start and end, of at most so much together or of one row."""
    ends = np.cumsum(sizes, dtype=np.int64)
    at, done = 0, 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, end
        at, done = end, int(ends[end - 1])


def folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (doc_id, owned, c0, c1, …) as FOLDED.

    All of a term's postings in these rows stand together, in chunks; each row has a
    posting of the empty term too."""
    rows, lists = batch.num_rows, batch.columns[2:]
    counts = [c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in lists]
    every = np.arange(rows, dtype=np.int32)
    of = np.concatenate([every, *[np.repeat(every, n) for n in counts]])
    pos = np.concatenate([np.full(rows, -1), *[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in counts]]).astype(np.int32)
    col = np.repeat(np.array([0, *range(len(lists))], dtype=np.int8), [rows, *[n.sum() for n in counts]])
    words = pa.concat_arrays([pa.array([""] * rows, pa.string()), *[c.flatten().cast(pa.string()) for c in lists]]).dictionary_encode()
    codes = words.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    each = np.bincount(codes, minlength=len(words.dictionary))
    chunks = -(-each // CHUNK)
    within = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    starts = np.append(np.repeat(np.cumsum(each) - each, chunks) + within * CHUNK, len(codes)).astype(np.int32)
    owned = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    packed = (sum(counts) << 1 | owned)[of] << 32 | (col.astype(np.int64) << 29) | (pos + 1)
    fields = [batch.column(0).take(pa.array(of[order])), pa.array(packed[order])]
    term = words.dictionary.take(pa.array(np.repeat(np.arange(len(each)), chunks)))
    return pa.RecordBatch.from_arrays([*[pa.ListArray.from_arrays(pa.array(starts), f) for f in fields], term], ["doc_id", "told", "term"])


def stored(rows: DataFrame, key: str, columns: Sequence[str], owned: str) -> DataFrame:
    """Postings as an engine keeps them: FOLDED, from one pass and without a shuffle.

    Postings of a term are gathered where its rows are read, so that what is moved and
    sorted is a row for many of them.  Each posting has its row's length, and each row one
    posting of the empty term, from which the corpus is counted."""
    if len(columns) > 8:
        raise ValueError("an index has eight columns at most")
    base = tokenised(rows, key, columns, [owned])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[2:])
            for start, end in blocks(sizes + 1, GATHERED):
                yield folded(batch.slice(start, end - start))

    return base.select(F.col("doc_id").cast("long"), owned, *[f"c{i}" for i in range(len(columns))]).mapInArrow(run, FOLDED)


def unfolded(post: DataFrame) -> DataFrame:
    """Stored postings one by one: doc_id, len, owned, col, pos, term.

    An index of before has them so already."""
    if post.schema["doc_id"].dataType.typeName() != "array":
        return post
    each = post.select(F.inline(F.arrays_zip("doc_id", "told")), "term")

    def bits(at: int, n: int):
        return F.shiftright("told", at).bitwiseAND(F.lit((1 << n) - 1))

    return each.select(
        "doc_id", bits(33, 31).cast("int").alias("len"), (bits(32, 1) == 1).alias("owned"), bits(29, 3).cast("tinyint").alias("col"), (bits(0, 29) - 1).cast("int").alias("pos"), "term",
    )


def stored_corpus(post: DataFrame) -> DataFrame:
    """n_docs, n_tokens of stored postings."""
    return corpus(unfolded(post.where("term = ''")).select("len"))


def postings(rows: DataFrame, key: str, columns: Sequence[str], terms: Sequence[str] | None = None) -> DataFrame:
    """doc_id, col, pos, term; with ``terms`` others are dropped before rows multiply."""
    base = tokenised(rows, key, columns)
    hits = [placed(i) if terms is None else F.filter(placed(i), lambda x: x["term"].isin(list(terms))) for i in range(len(columns))]
    every = F.concat(*hits) if len(hits) > 1 else hits[0]
    return base.select("doc_id", F.inline(every))


def lengths(rows: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """doc_id, len: tokens over all columns; rows without tokens count too."""
    base = tokenised(rows, key, columns)
    total = sum((F.size(f"c{i}") for i in range(1, len(columns))), F.size("c0"))
    return base.select("doc_id", total.alias("len"))


def corpus(lens: DataFrame) -> DataFrame:
    """One row: n_docs, n_tokens."""
    return lens.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("n_tokens"))


def term_rows(post: DataFrame) -> DataFrame:
    """term, doc, cnt: rows that have the term, and its instances."""
    per = post.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


def vocabulary(*posts: DataFrame) -> DataFrame:
    """term: the distinct terms of several indexes."""
    out = posts[0].select("term")
    for post in posts[1:]:
        out = out.union(post.select("term"))
    return out.distinct()
