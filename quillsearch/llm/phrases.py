"""Document fingerprints from Lempel-Ziv phrases.

A text's words are parsed as LZ78 does: the longest phrase already in the
text's own dictionary, plus one word, is the next phrase.  The set of phrases,
hashed, gets a minimum-hash signature of ``HASHES`` values, kept to four bits
each for comparison.  Two texts are alike when the similarity estimated from
their signatures is at least ``THRESHOLD``; bands of whole minima find the
candidates, and groups are the connected components of the accepted pairs.

Equal signatures are one node.  Inside a bucket pairs that are already
connected are passed over, so a crowd of copies costs little, and every other
pair is compared: there is no cap on bucket or partners.  A bucket of more than
``CROWD`` nodes is compared block by block, each pair of blocks a bucket of its
own that may go to another task.

Defined cases: a null text has no phrases, a null signature and a group of its
own; texts without words have their bytes as the only phrase and group when
equal; texts of any length are parsed whole; a last phrase that is already in the
dictionary adds nothing; groups are named by their least doc_id (nulls last), so
groups without ids have a null name and groups that share their least id share it;
repeated rows are copies; an empty table gives no rows; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .simhash import components, first_of, first_rows
from .tools import cut, over_text, parts

HASHES = 128
#: 21 bands of 6 find a pair at the threshold with probability 0.93, a chance pair (0.1) with 2e-5.
BANDS, ROWS = 21, 6
THRESHOLD = 0.7
#: Nodes of a bucket that are compared in one go.
CROWD = 4096
#: Rows (band, node) that one task sorts.
CELL_ROWS = 4_000_000

_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def parse(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct phrases, and the len+1 offsets of each text's."""
    h, first = kernels.words(raw, at)
    distinct, local = np.unique(h, return_inverse=True)
    bits = max(1, int(len(distinct)).bit_length())
    symbols = local.tolist()
    keys: list[int] = []
    count = [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        book: dict[int, int] = {}
        get = book.get
        node, size = 0, 1
        for symbol in symbols[a:b]:
            key = node << bits | symbol
            node = get(key)
            if node is None:
                book[key] = size
                size += 1
                node = 0
        keys.extend(book)
        count.append(len(keys))
    at_key = np.array(count, dtype=np.int64)
    key = np.array(keys, dtype=np.int64)
    symbol, parent = key & ((1 << bits) - 1), key >> bits
    # a phrase's hash follows from its parent's; parents come first, so go by depth
    base = np.repeat(at_key[:-1], np.diff(at_key))
    up = np.where(parent > 0, base + parent - 1, -1)
    hashes = kernels.mix(distinct[symbol] + np.uint64(1)) if len(key) else np.zeros(0, np.uint64)
    ready = up < 0
    left = np.flatnonzero(~ready)
    while len(left):
        now = left[ready[up[left]]]
        hashes[now] = kernels.mix(hashes[up[now]] * np.uint64(0x9E3779B97F4A7C15) + distinct[symbol[now]])
        ready[now] = True
        left = left[~ready[left]]
    bare = np.flatnonzero((np.diff(at_key) == 0) & (np.diff(at) > 0))
    if len(bare):
        alone = kernels.mix(kernels.run_hashes(raw, at[bare], at[bare + 1], kernels._RAW) + np.uint64(9))
        hashes = np.insert(hashes, at_key[bare], alone)
        at_key = at_key + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(at) - 1), bare))])
    return hashes, at_key


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minimum hashes, a row per text; all ones for a text without phrases."""
    out = np.full((len(at) - 1, HASHES), np.iinfo(np.uint64).max, dtype=np.uint64)
    full = np.diff(at) > 0
    if full.any():
        begin = at[:-1][full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(hashes * _MULTIPLY[k] + _ADD[k], begin)
    return out


def nibbles(signature: np.ndarray) -> np.ndarray:
    """Four bits of each minimum, two to a byte: 64 bytes a text."""
    low = (kernels.mix(signature) & np.uint64(15)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def similarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The estimated similarity of rows of nibbles, freed of chance matches."""
    z = x ^ y
    match = ((z & 15) == 0).sum(axis=-1) + ((z >> 4) == 0).sum(axis=-1)
    return (match / HASHES - 1 / 16) / (1 - 1 / 16)


def fingerprints(documents: DataFrame) -> DataFrame:
    """Columns doc_id, n_phrases, signature (64 bytes), node, bands; no node for a null text."""

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        hashes, cuts = parse(raw, at)
        signature = signatures(hashes, cuts)
        small = nibbles(signature)
        factor = kernels.mix(np.arange(HASHES, dtype=np.uint64)) | np.uint64(1)
        node = kernels.mix((kernels.mix(signature) * factor).sum(axis=1, dtype=np.uint64))
        band = (kernels.mix(signature) * factor)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).sum(axis=2, dtype=np.uint64)
        missing = np.asarray(batch.column("text").is_null())
        data = pa.array([None if m else s.tobytes() for s, m in zip(small, missing, strict=True)], pa.binary())
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(at), dtype=np.int32) * BANDS), pa.array(kernels.mix(band).view(np.int64).ravel()))
        return {"doc_id": batch.column("doc_id"), "n_phrases": np.diff(cuts), "signature": data, "node": pa.array(node.view(np.int64), mask=missing), "bands": bands}

    return over_text(documents, "doc_id long, n_phrases long, signature binary, node long, bands array<long>", work)


def forest(key: np.ndarray, same: Callable, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the pairs with one key for which
    ``same(i, j)`` holds, over all pairs; keys must be sorted.

    Where a key has several sides, only pairs of different sides count."""
    n = len(key)
    parent = np.arange(n)
    left, right = [], []
    here = np.arange(n)
    whole = np.ones(n, dtype=bool)
    if side is not None and n:
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(begin, n))
        whole = np.repeat(np.minimum.reduceat(side, begin) == np.maximum.reduceat(side, begin), size)
    step = 1
    while len(here):
        here = here[here + step < n]
        here = here[key[here] == key[here + step]]
        ask = here[parent[here] != parent[here + step]]
        if side is not None:
            ask = ask[whole[ask] | (side[ask] != side[ask + step])]
        hit = ask[same(ask, ask + step)] if len(ask) else ask
        for u in hit.tolist():
            a, b = u, u + step
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(u)
                right.append(u + step)
        if len(hit):
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
        step += 1
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def blocked(band: np.ndarray, node: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, nodes and sides of buckets to compare, from sorted (band, node) pairs.

    A band of up to ``most`` nodes is one bucket.  A larger one is cut into blocks, and
    each two of them, and each by itself, are a bucket: together they have all pairs."""
    if len(band) == 0:
        return
    begin = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    size = np.diff(np.append(begin, len(band)))
    small = np.repeat(size <= most, size)
    key = kernels.mix(band.view(np.uint64))
    yield key[small].view(np.int64), node[small], np.zeros(int(small.sum()), dtype=np.int32)
    for at, n in zip(begin[size > most].tolist(), size[size > most].tolist(), strict=True):
        blocks = -(-n // most)
        for i in range(blocks):
            mine = node[at + i * most : min(at + (i + 1) * most, at + n)]
            other = np.arange(blocks, dtype=np.uint64)
            pair = np.minimum(other, np.uint64(i)) * np.uint64(blocks) + np.maximum(other, np.uint64(i))
            keys = kernels.mix(key[at] + kernels.mix(pair + np.uint64(1))).view(np.int64)
            yield np.repeat(keys, len(mine)), np.tile(mine, blocks), np.full(blocks * len(mine), i, dtype=np.int32)


def alike(rows: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all nodes of rows (node, signature, bands) that are alike.

    Bare (band, node) pairs go round first; most bands have one node and end
    there.  Only the crowded ones are given their signatures and compared."""
    cells = max(parts(rows.sparkSession), -(-rows.count() * BANDS // CELL_ROWS))
    pairs = rows.select(F.explode("bands").alias("band"), "node")

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(batch.column("band").to_numpy(), batch.column("node").to_numpy()) for batch in batches]
        if not got:
            return
        band, node = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((node, band))
        band, node = band[order], node[order]
        new = np.ones(len(band), dtype=bool)
        new[1:] = (band[1:] != band[:-1]) | (node[1:] != node[:-1])
        band, node = band[new], node[new]
        same = band[1:] == band[:-1]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(band) else np.zeros(0, dtype=bool)
        for key, member, side in blocked(band[many], node[many], crowd):
            yield pa.RecordBatch.from_pydict({"bucket": key, "node": member, "side": side})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        bucket, node, side = (got[c].to_numpy() for c in ("bucket", "node", "side"))
        order = np.lexsort((side, bucket))
        small = np.frombuffer(b"".join(got["signature"].to_pylist()), np.uint8).reshape(-1, HASHES // 2)[order]
        bucket, node, side = bucket[order], node[order], side[order]
        a, b = forest(bucket, lambda i, j: similarity(small[i], small[j]) >= threshold, side)
        yield pa.RecordBatch.from_pydict({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    def by(df: DataFrame, column: str) -> DataFrame:
        return df.repartitionById(cells, F.pmod(F.col(column), F.lit(cells)).cast("int"))

    found = by(pairs, "band").mapInArrow(crowded, "bucket long, node long, side int")
    signatures = rows.groupBy("node").agg(F.first("signature").alias("signature"))
    full = found.join(signatures, "node").select("bucket", "node", "side", "signature")
    return by(full, "bucket").mapInArrow(meet, "a long, b long")


def groups(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Columns doc_id, n_phrases, signature, group_id: one row per row of documents."""
    rows = cut(fingerprints(documents).withColumn("row", F.monotonically_increasing_id()))
    known = rows.where(F.col("node").isNotNull())
    nodes = cut(known.groupBy("node").agg(first_of(), F.count("*").alias("n")))
    named = rows.join(first_rows(nodes, components(alike(known, threshold))), "node", "left")
    group_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return named.select("doc_id", "n_phrases", "signature", group_id.alias("group_id"))
