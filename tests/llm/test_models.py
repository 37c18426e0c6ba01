"""Quality and toxicity: held-out accuracy, plain versions, odd rows."""

import numpy as np
import pytest

from quillsearch.llm import quality, toxicity

from . import brute
from .conftest import CLASH, ODD

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return d.join(labels.select("doc_id"), "doc_id"), labels.where("doc_id % 4 <> 0"), {r["doc_id"]: r for r in labels.where("doc_id % 4 = 0").collect()}


def test_quality_held_out(held_out):
    d, train, test = held_out
    got = {r["doc_id"]: r["keep"] for r in quality.classify(d, train).collect()}
    right = [got[i] == bool(r["quality"]) for i, r in test.items()]
    assert np.mean(right) > 0.97
    assert np.mean([got[i] for i, r in test.items() if r["quality"]]) > 0.98


def test_toxicity_held_out(held_out):
    d, train, test = held_out
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(d, train).collect()}
    assert np.mean([got[i] for i, r in test.items() if r["toxic"]]) > 0.9
    assert np.mean([got[i] for i, r in test.items() if not r["toxic"]]) < 0.01


def small(documents, spark):
    good = [f"the plain text number {i} goes on and on, quietly." for i in range(30)]
    bad = [f"BUY!! NOW!! {i}!! ### $$$ ### $$$" for i in range(12)]
    rude = [f"you are a moron {i}, a real moron and clown" for i in range(12)]
    texts = [*good, *bad, *rude, *ODD]
    labels = [(i, 1, 0) for i in range(0, 30, 2)] + [(i, 0, 0) for i in range(30, 42, 2)] + [(i, 1, 1) for i in range(42, 54, 2)] + [(42, 1, 1), (None, 1, 1), (3, None, None), (54, 0, 1), (999, 0, 1)]
    return documents(texts, extra=CLASH), list(enumerate(texts)), labels, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_plain(documents, spark):
    d, rows, labels, frame = small(documents, spark)
    want = brute.keep_good(rows, [(i, q) for i, q, _ in labels], range(100))
    got = quality.classify(d, frame).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["keep"]} == {i for i, _ in want}
    kept = quality.keep_good(d, frame)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in want}
    assert not {31, 33} & {i for i, _ in want} and {1, 3, 5} <= {i for i, _ in want}


def test_toxicity_plain(documents, spark):
    d, rows, labels, frame = small(documents, spark)
    want = {i for i, _ in brute.keep_clean(rows, [(i, t) for i, _, t in labels])}
    got = toxicity.classify(d, frame).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if not r["toxic"]} == want
    kept = toxicity.keep_clean(d, frame)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == want


@pytest.mark.parametrize("f,flag", [(quality.classify, ("keep", True)), (toxicity.classify, ("toxic", False))])
def test_without_labels_or_rows(documents, spark, f, flag):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    rows = f(documents(["x", None]), none).collect()
    assert [(r["score"], r[flag[0]]) for r in rows] == [(None, flag[1])] * 2
    assert f(documents([]), some).count() == 0
    assert f(documents(["x", "x", "x y"], [1, 1, None]), some).count() == 3


def test_sample_is_bounded(documents, spark):
    d = documents([f"text {i}" for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(50)], "doc_id long, quality int, toxic int")
    assert len(quality.fit(d, labels, 20)["labels"]) == 20
    assert toxicity.fit(d, labels, 20) is not None


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    examples = [(np.unique(np.concatenate([rng.integers(100, 4000, 30), [7] if y else [8]])), int(y)) for y in rng.random(400) < 0.3]
    bias, used, weight = toxicity.ftrl(examples)
    assert 7 in used and len(used) < 60 and weight[list(used).index(7)] == weight.max()


@pytest.mark.parametrize("module", (quality, toxicity))
def test_repeated_ids_fit_alike_in_any_order(documents, spark, module):
    """Of several texts under one labelled id the same one is fitted on."""
    texts = [*(f"the plain text number {i} goes on, quietly." for i in range(8)), *(f"BUY!! NOW!! {i}!! ### $$$" for i in range(8))]
    ids = [1, 2, 3, 4, 1, 2, 3, None, 1, 2, 5, 6, 7, 8, 9, None]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 10)], "doc_id long, quality int, toxic int")
    turn = list(range(len(texts)))
    out = []
    for order in (turn, turn[::-1]):
        got = module.classify(documents([texts[k] for k in order], [ids[k] for k in order]).coalesce(1), labels)
        flag = got.columns[2]
        out.append(sorted((str(r["doc_id"]), round(r["score"], 6), r[flag]) for r in got.collect()))
    assert out[0] == out[1]
