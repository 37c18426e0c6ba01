"""Token-ID output: canonical length-limited Huffman blocks.

Documents are encoded to ids (the BPE encoder); global id counts give code
lengths of at most ``LIMIT`` bits by package-merge, and canonical codes follow
from the lengths alone.  A document's ids are written in independent blocks of
``BLOCK`` ids; checkpoints hold each block's first bit, so any block can be
decoded by itself.  Decoding walks all blocks at once through one table of
2**LIMIT entries.

Defined cases: a null or empty text has no ids, no bits and no checkpoints; a
single distinct id gets a code of one bit; ids without a count have no code, and
encoding one raises; equal counts are ordered by id; texts of any length are
encoded whole; repeated rows and doc_ids are encoded each, null ones too; an empty
table gives no rows; other columns, whatever their names, are not read.

The codes follow from the lengths, so a checked result carries them: the first row
of each partition has ``code_lengths``, a byte per id, the same in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, kernels
from .tools import cut, over_text

LIMIT = 20
BLOCK = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths up to the limit; 0 where the count is 0."""
    out = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts > 0)
    if len(used) == 0:
        return out
    if len(used) == 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.lexsort((used, counts[used]))]
    n, leaf = len(order), counts[order].astype(np.int64)
    # package-merge: per level the packages, pairs of the level below, join the leaves
    packages = np.zeros(0, dtype=np.int64)
    marks = []
    for _ in range(limit):
        weight = np.concatenate([leaf, packages])
        rank = np.argsort(weight, kind="stable")
        marks.append(rank < n)
        merged = weight[rank]
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take = 2 * n - 2
    for mark in reversed(marks):
        chosen = int(mark[:take].sum())
        out[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each id, by (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths > 0)
    order = used[np.lexsort((used, lengths[used]))]
    size = lengths[order]
    if len(order):
        step = np.left_shift(np.int64(1), int(size[-1]) - size)
        full = np.cumsum(step) - step
        codes[order] = (full >> (int(size[-1]) - size)).astype(np.uint64)
    return codes


def pack_bits(codes: np.ndarray, lengths: np.ndarray, start: np.ndarray, total: int) -> np.ndarray:
    """Bytes with each code, high bit first, at its first bit; total bits overall."""
    words = np.zeros(total // 32 + 2, dtype=np.uint64)
    place, shift = start >> 5, start & 31
    # a code of up to 32 bits spans two words at most; codes start in ascending order
    wide = codes << (64 - shift - lengths).astype(np.uint64)
    high, low = wide >> np.uint64(32), wide & np.uint64(0xFFFFFFFF)
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        words[place[first]] += np.add.reduceat(high, first)
        words[place[first] + 1] += np.add.reduceat(low, first)
    return words.astype(">u4").view(np.uint8)[: (total + 7) // 8]


class Codec:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        self.codes = canonical(lengths)
        self.limit = max(1, int(lengths.max(initial=0)))
        table = np.full(1 << self.limit, -1, dtype=np.int64)
        for_id = np.flatnonzero(lengths > 0)
        span = np.left_shift(np.int64(1), self.limit - lengths[for_id])
        start = (self.codes[for_id].astype(np.int64)) << (self.limit - lengths[for_id])
        index = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
        table[np.repeat(start, span) + index] = np.repeat(for_id, span)
        self.table = table

    def encode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all documents: bytes, byte offsets (len+1), checkpoints, their offsets (len+1)."""
        n = np.diff(at)
        size = self.lengths[ids]
        if len(ids) and int(size.min()) == 0:
            raise ValueError("an id has no code")
        before = np.concatenate([[0], np.cumsum(size)])
        bits = before[at[1:]] - before[at[:-1]]
        byte_at = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
        shift = 8 * byte_at[:-1] - before[at[:-1]]
        owner = np.repeat(np.arange(len(n)), n)
        start = before[:-1] + shift[owner]
        data = pack_bits(self.codes[ids], size, start, int(8 * byte_at[-1]))
        head = np.flatnonzero((np.arange(len(ids)) - at[:-1][owner]) % BLOCK == 0)
        points = (start[head] - 8 * byte_at[owner[head]]).astype(np.int64)
        return data, byte_at, points, np.searchsorted(head, at)

    def decode(self, data: np.ndarray, byte_at: np.ndarray, points: np.ndarray, point_at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """All ids in a row.  Blocks advance together, a table look-up an id each."""
        out = np.zeros(int(counts.sum()), dtype=np.int32)
        if len(out) == 0:
            return out
        blocks = np.diff(point_at)
        owner = np.repeat(np.arange(len(counts)), blocks)
        number = np.arange(len(points)) - point_at[:-1][owner]
        left = np.minimum(BLOCK, counts[owner] - BLOCK * number)
        target = (np.cumsum(counts) - counts)[owner] + BLOCK * number
        bit = points + 8 * byte_at[:-1][owner]
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        window = padded[:-3] << np.uint64(24) | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(8) | padded[3:]
        order = np.argsort(-left, kind="stable")
        left, target, bit = left[order], target[order].copy(), bit[order].copy()
        drop = np.uint64(32 - self.limit)
        mask = np.int64((1 << self.limit) - 1)
        for step in range(int(left[0])):
            live = int(np.searchsorted(-left, -step, side="left"))
            at = bit[:live]
            peek = ((window[at >> 3] << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> drop
            ids = self.table[peek.astype(np.int64) & mask]
            out[target[:live]] = ids
            target[:live] += 1
            bit[:live] += self.lengths[ids]
        return out


def binary(at: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def encode(documents: DataFrame, vocabulary: str = bpe.VOCABULARY, limit: int = LIMIT, checked: bool = False) -> tuple[DataFrame, np.ndarray]:
    """Columns doc_id, n_ids, data, checkpoints; and the code lengths by id.

    If checked, also exact, whether decoding from the checkpoints gives a document's
    ids back, and code_lengths (see ``stored_lengths``)."""

    made = bpe.shipped(documents, vocabulary)

    def tokens(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        ids, cuts = made().encode(raw, at)
        # ids travel as bytes between the two passes, two each where they fit
        width = 2 if made().size <= 1 << 16 else 4
        return {"doc_id": batch.column("doc_id"), "width": np.full(len(at) - 1, width, dtype=np.int32), "ids": binary(cuts * width, ids.astype(f"<u{width}"))}

    rows = cut(over_text(documents, "doc_id long, width int, ids binary", tokens))

    def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        if batch.num_rows == 0:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        column = batch.column("ids").cast(pa.large_binary())
        raw, at = kernels.buffers(column)
        width = int(batch.column("width")[0].as_py())
        return np.frombuffer(raw.tobytes(), f"<u{width}").astype(np.int64), at // width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            ids, _ = unpacked(batch)
            more = np.bincount(ids)
            if len(more) > len(total):
                more[: len(total)] += total
                total = more
            else:
                total[: len(more)] += more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": used.astype(np.int64), "n": total[used].astype(np.int64)})

    # a row per id of the vocabulary comes back, whatever the corpus
    counts = rows.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, dtype=np.int64)
    dense[counts["id"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    lengths = code_lengths(dense, limit)
    shared = documents.sparkSession.sparkContext.broadcast(lengths)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        table = codec.lengths.astype(np.uint8).tobytes()
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids, at = unpacked(batch)
                data, byte_at, points, point_at = codec.encode(ids, at)
                marks = pa.ListArray.from_arrays(pa.array(point_at.astype(np.int32)), pa.array(points))
                out = {"doc_id": batch.column("doc_id"), "n_ids": np.diff(at), "data": binary(byte_at, data), "checkpoints": marks}
                if checked and batch.num_rows:
                    wrong = codec.decode(data, byte_at, points, point_at, np.diff(at)) != ids
                    before = np.concatenate([[0], np.cumsum(wrong)])
                    out["exact"] = before[at[1:]] == before[at[:-1]]
                    out["code_lengths"] = pa.array([table] + [None] * (batch.num_rows - 1), pa.binary())
                    table = None
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_ids long, data binary, checkpoints array<long>"
    return rows.mapInArrow(write, schema + (", exact boolean, code_lengths binary" if checked else "")), lengths


def encode_and_check(documents: DataFrame, vocabulary: str = bpe.VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """Columns doc_id, n_ids, data, checkpoints, exact, code_lengths: a result that can be decoded by itself."""
    return encode(documents, vocabulary, limit, checked=True)[0]


def stored_lengths(encoded: DataFrame) -> np.ndarray:
    """The code lengths by id that a checked result carries."""
    row = encoded.where(F.col("code_lengths").isNotNull()).select("code_lengths").first()
    return np.frombuffer(bytes(row[0]), np.uint8).astype(np.int64) if row else np.zeros(1, np.int64)


def decode(encoded: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Columns doc_id, ids: the inverse of encode, given the code lengths."""
    shared = encoded.sparkSession.sparkContext.broadcast(lengths)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            data, byte_at = kernels.buffers(batch.column("data").cast(pa.large_binary()))
            marks = batch.column("checkpoints")
            at = marks.offsets.to_numpy()
            points = marks.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
            counts = batch.column("n_ids").to_numpy()
            ids = codec.decode(data, byte_at, points, at - at[0], counts)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": bpe.id_lists(ids, np.concatenate([[0], np.cumsum(counts)]))})

    return encoded.select("doc_id", "n_ids", "data", "checkpoints").mapInArrow(read, "doc_id long, ids array<int>")
