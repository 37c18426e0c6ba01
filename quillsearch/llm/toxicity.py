"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features are the presence of word unigrams (whole and cut to stems), bigrams
and skip-grams (one word left out), hashed to ``2**BITS`` slots.  A bounded sample of labelled texts is
brought to one task, which runs FTRL-proximal over it: per-coordinate rates and
L1 leave a short list of weights, which is broadcast to score every document.

Defined cases: a null or empty text has no features and scores by the bias
alone; a label that is null, or of a document without text, is not used;
several labels of one document count as toxic if any does; of several texts under
one labelled doc_id the one whose hash is least is fitted on; without labels every
score is null and every document is kept; equal documents get equal scores; texts of
any length are read whole; repeated rows and null doc_ids are scored each; an empty
table gives no rows; other columns, whatever their names, are kept by ``keep_clean``
and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .tools import over_text

BITS = 22
#: Words also count by their first so many bytes, which joins inflected forms.
STEMS = (4, 6)
#: Bound of the labelled sample that the model is fitted on.
MAX_LABELLED = 16384
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
EPOCHS = 3
THRESHOLD = 0.5


def slots(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots and their text numbers, with repeats."""
    starts, ends, first = kernels.runs(raw, at, kernels._WORD)
    h = kernels.run_hashes(raw, starts, ends)
    owner = kernels.owners(first)
    stems = [kernels.mix(kernels.run_hashes(raw, starts, np.minimum(ends, starts + k)) + np.uint64(k)) for k in STEMS]
    two, two_owner = kernels.grams(h, owner, (1,))
    skip, skip_owner = kernels.grams(h, owner, (2,))
    return np.concatenate([h, *stems, two, skip]) & np.uint64((1 << BITS) - 1), np.concatenate([owner] * (1 + len(STEMS)) + [two_owner, skip_owner])


def distinct(slot: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | slot)
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), (key >> np.uint64(BITS)).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, slots and weights after the epochs, in the order of the examples."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(epochs):
        for x, y in examples:
            zx, nx = z[x], n[x]
            w = weight(zx, nx)
            b = -zb / ((BETA + nb**0.5) / ALPHA)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x] = zx + g - sigma * w
            n[x] = nx + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * b
            nb += g * g
    used = np.flatnonzero(np.abs(z) > L1)
    return -zb / ((BETA + nb**0.5) / ALPHA), used, weight(z[used], n[used])


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> dict | None:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    # the sample is drawn from the narrow labels, so that only its texts are moved
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(sample), "doc_id")

    def featurise(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        x, owner = distinct(*slots(raw, at))
        offsets = np.searchsorted(owner, np.arange(len(at)))
        return {"doc_id": batch.column("doc_id"), "hash": batch.column("hash"), "label": batch.column("label"), "x": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x.astype(np.int32)))}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for batch in batches:
            lists = batch.column("x")
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (doc, hash, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "hash", "label")), strict=True)):
                if doc not in rows or hash < rows[doc][0]:
                    rows[doc] = (hash, values[offsets[i] : offsets[i + 1]].copy(), label)
        if rows:
            ids = np.array(sorted(rows), dtype=np.int64)
            ids = ids[np.argsort(kernels.mix(ids.view(np.uint64)), kind="stable")][:max_labelled]
            bias, used, weights = ftrl([rows[i][1:] for i in ids.tolist()])
            yield pa.RecordBatch.from_pydict({"slot": np.concatenate([[-1], used]), "weight": np.concatenate([[bias], weights])})

    rows = over_text(texts, "doc_id long, hash long, label int, x array<int>", featurise, also=("doc_id", "hash", "label"))
    got = rows.repartition(1).mapInArrow(train, "slot long, weight double").toArrow()
    if got.num_rows == 0:
        return None
    slot, weight = got["slot"].to_numpy(), got["weight"].to_numpy()
    return {"bias": float(weight[slot == -1][0]), "slots": slot[slot >= 0], "weights": weight[slot >= 0]}


class Scorer:
    """Scores slices of texts; made once a task from the compact weights."""

    def __init__(self, model: dict):
        self.bias = model["bias"]
        self.dense = np.zeros(1 << BITS, dtype=np.float32)
        self.dense[model["slots"]] = model["weights"]

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        slot, owner = slots(raw, at)
        hit = self.dense[slot.astype(np.int64)] != 0
        slot, owner = distinct(slot[hit], owner[hit])  # only slots with a weight are sorted
        total = np.bincount(owner, weights=self.dense[slot], minlength=len(at) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Columns doc_id, score, toxic: one row per row of documents."""
    model = fit(documents, labels, max_labelled)
    if model is None:
        return documents.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(False).alias("toxic"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    made: list[Scorer] = []

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Scorer(shared.value))
        score = made[0](raw, at)
        return {"doc_id": batch.column("doc_id"), "score": score, "toxic": score >= threshold}

    return over_text(documents, "doc_id long, score double, toxic boolean", work)


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of documents that are not toxic, with all their columns."""
    model = fit(documents, labels, max_labelled)
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            raw, at = kernels.buffers(kernels.as_large(batch.column("text")))
            for a, b in kernels.slices(np.diff(at)):
                score = scorer(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                yield batch.slice(a, b - a).filter(pa.array(score < threshold))

    return documents.mapInArrow(run, documents.schema)
