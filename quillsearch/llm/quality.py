"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are hashed token shapes, shape bigrams, repeats of the token
before, and words.  A bounded sample of labelled texts gives inverse document
frequencies and a truncated singular value decomposition; its members,
projected and normalised, are broadcast.  Each document is projected likewise,
compared with all of them by blocked exact cosine products, and the labels of
its ``neighbours`` nearest are averaged with weights ``max(cosine, 0) ** power``.

Defined cases: a null or empty text, like any text all but outside the latent
space, has no direction and gets the share of good labels; without usable labels every score
is null and every document is kept; a labelled document whose label or text is
null is not used; several labels of one document are averaged; of several texts
under one labelled doc_id the one whose hash is least is fitted on; equal cosines
(to a millionth) are ordered by doc_id; texts of any length are read whole; repeated
rows and null doc_ids are scored each; an empty table gives no rows; other columns,
whatever their names, are kept by ``keep_good`` and not read otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .tools import over_text

SHAPE_DIMS = 1024
WORD_DIMS = 1024
RANK = 48
#: Bound of the labelled sample that the classifier is fitted on.
MAX_LABELLED = 4096
NEIGHBOURS = 15
POWER = 4.0
THRESHOLD = 0.5
WORD_WEIGHT = 0.25
#: A projection shorter than this (of texts of unit length) is no direction.
FAINT = 0.05

_TOKEN = np.ones(256, dtype=bool)
_TOKEN[[9, 10, 11, 12, 13, 32]] = False
#: A byte's class: letters by case, digits, continuation as lower case, the rest themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3


def terms(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The texts' dense count matrix over hashed terms, log-damped, rows by text."""
    n = len(at) - 1
    out = np.zeros((n, SHAPE_DIMS + WORD_DIMS), dtype=np.float32)
    if len(raw) == 0:
        return out
    starts, ends, first = kernels.runs(raw, at, _TOKEN)
    owner = kernels.owners(first)
    if len(starts):
        kind = _CLASS[raw]
        # a shape keeps one byte of each run of a class, so any word of lower case looks alike
        new = np.ones(len(raw), dtype=bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts] = True
        before = np.concatenate([[0], np.cumsum(new)])
        short = kind[new]
        shape = kernels.run_hashes(short, before[starts], before[ends])
        word = kernels.run_hashes(raw, starts, ends)
        same = np.zeros(len(word), dtype=bool)
        same[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        shape = kernels.mix(shape + same.astype(np.uint64))
        pair, pair_owner = kernels.grams(shape, owner, (1,))
        rows = np.concatenate([owner, pair_owner])
        slots = np.concatenate([shape, pair]) % np.uint64(SHAPE_DIMS)
        width = SHAPE_DIMS + WORD_DIMS
        flat = np.bincount(rows * width + slots.astype(np.int64), minlength=n * width)
        flat += np.bincount(owner * width + SHAPE_DIMS + (word % np.uint64(WORD_DIMS)).astype(np.int64), minlength=n * width)
        out = np.log1p(flat.reshape(n, width).astype(np.float32))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    s, w = unit(x[:, :SHAPE_DIMS]), unit(x[:, SHAPE_DIMS:])
    return np.hstack([s, WORD_WEIGHT * w])


def decompose(x: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    rank = max(1, min(rank, *x.shape))
    basis = np.random.default_rng(7).standard_normal((x.shape[1], rank)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    # rotate to the singular directions and leave out those that hold nothing
    _, size, turn = np.linalg.svd(x @ basis, full_matrices=False)
    return basis @ turn[size > 1e-3 * size[0]].T


def project(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit latent vectors; zero for a text that is all but outside the space."""
    y = x @ basis
    y[np.sqrt((y * y).sum(axis=1)) < FAINT] = 0
    return unit(y)


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK) -> dict | None:
    """The model, from at most ``max_labelled`` labelled documents; None without any."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
    # the sample is drawn from the narrow labels, so that only its texts are moved
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(sample), "doc_id")

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        x = terms(raw, at)
        row, slot = np.nonzero(x)
        count = np.bincount(row, minlength=len(x))
        offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
        return {"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "label": batch.column("label"), "slots": pa.ListArray.from_arrays(offsets, pa.array(slot.astype(np.int16))), "counts": pa.ListArray.from_arrays(offsets, pa.array(x[row, slot]))}

    rows = over_text(texts, "doc_id long, hash long, label double, slots array<short>, counts array<float>", work, also=("doc_id", "hash", "label"))
    # a repeated document counts once, so no more rows come back than are sampled
    got = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "slots", "counts"), "hash").alias("one")).select("doc_id", "one.*").toArrow()
    if got.num_rows == 0:
        return None
    ids = got["doc_id"].to_numpy()
    slots, counts = got["slots"].combine_chunks(), got["counts"].combine_chunks()
    lengths = np.diff(slots.offsets.to_numpy())
    order = np.argsort(ids, kind="stable")
    x = np.zeros((len(ids), SHAPE_DIMS + WORD_DIMS), dtype=np.float32)
    x[np.repeat(np.arange(len(ids)), lengths), slots.flatten().to_numpy().astype(np.int64)] = counts.flatten().to_numpy()
    x, label = x[order], got["label"].to_numpy()[order].astype(np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = weigh(x, idf)
    basis = decompose(x, rank)
    return {"idf": idf, "basis": basis, "vectors": project(x, basis), "labels": label}


def votes(counts: np.ndarray, model: dict, neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
    """Each row's weighted mean label of its nearest labelled vectors."""
    prior = float(model["labels"].mean())
    x = project(weigh(counts, model["idf"]), model["basis"])
    vectors, labels = model["vectors"], model["labels"]
    k = min(neighbours, len(labels))
    out = np.empty(len(x))
    for a in range(0, len(x), 256):
        # whole millionths: equal vectors tie exactly, and ties go to the lower doc_id
        cosine = np.rint((x[a : a + 256] @ vectors.T).astype(np.float64) * 1e6)
        cosine -= np.arange(len(labels)) / (2 * len(labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k] if k < len(labels) else np.broadcast_to(np.arange(k), (len(cosine), k))
        weight = np.maximum(np.ceil(np.take_along_axis(cosine, near, axis=1)) / 1e6, 0) ** power
        total = weight.sum(axis=1)
        out[a : a + 256] = np.where(total > 0, (weight * labels[near]).sum(axis=1) / np.where(total > 0, total, 1), prior)
    return out


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Columns doc_id, score, keep: one row per row of documents."""
    model = fit(documents, labels, max_labelled)
    if model is None:
        return documents.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("keep"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        score = votes(terms(raw, at), shared.value)
        return {"doc_id": batch.column("doc_id"), "score": score, "keep": score >= threshold}

    return over_text(documents, "doc_id long, score double, keep boolean", work)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of documents that are not rejected, with all their columns.

    The rows pass through one Arrow map, so no join brings scores back."""
    model = fit(documents, labels, max_labelled)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            raw, at = kernels.buffers(kernels.as_large(batch.column("text")))
            for a, b in kernels.slices(np.diff(at)):
                score = votes(terms(raw[at[a] : at[b]], at[a : b + 1] - at[a]), shared.value)
                yield batch.slice(a, b - a).filter(pa.array(score >= threshold))

    return documents.mapInArrow(run, documents.schema)
