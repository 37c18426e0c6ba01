"""The whole pipeline against plain versions of its stages, and the registration."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline

from quillsearch.llm import queries

from . import brute
from .conftest import CLASH, ODD

ROOT = Path(__file__).parents[2]


def test_pipeline(spark, tmp_path):
    src = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{src}/documents.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{src}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    known = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    rows = sorted((r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect())
    rows = brute.keep_good(rows, [(i, q) for i, q, _ in known], {i for i, _, _ in known})
    rows = brute.keep_clean(rows, [(i, t) for i, _, t in known])
    seen = set()
    rows = [(i, t) for i, t in rows if not (t in seen or seen.add(t))]
    group = brute.near_groups(rows)
    rows = [(i, t) for i, t in rows if group[i] == i]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "bucket", "batch").collect())
    assert got == brute.packed(rows)
    assert 100 < len(got) < 190


def test_stages_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns and 0 < out.count() <= d.count(), name
    empty = d.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_stages_on_odd_rows(spark, documents):
    """Nulls, blanks, ties, repeats, long texts, shared ids and clashing columns, stage by stage."""
    sf = "/root/testdata/sf0.001"
    one, two = "the red fox runs over the hills and far away again", "quiet rivers carry cold stones to the sea at night"
    texts = [*ODD, one, one, two, two, None]
    ids = [None, *range(1, len(ODD)), 900, None, 900, None, 900]
    d = documents(texts, ids, CLASH)
    whole = sorted((-1 if r[0] is None else r[0], r[1] or "", r[1] is None) for r in d.select("doc_id", "text").collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, sf)
        if name == "packing":
            assert out.count() == len(texts)
            continue
        assert out.columns == d.columns
        kept = [(-1 if r[0] is None else r[0], r[1] or "", r[1] is None) for r in out.select("doc_id", "text").collect()]
        assert not Counter(kept) - Counter(whole), name
        if name.endswith("dedup"):
            assert sum(x[2] for x in kept) == texts.count(None)  # a null text is no copy
            plain = [x[1] for x in kept if not x[2]]
            if name == "exact_dedup":
                assert sorted(plain) == sorted({t for t in texts if t is not None})
            else:
                assert len(plain) == len(set(plain)) and {one, two, "", "你好 世界"} <= set(plain)
        else:
            # equal texts fare alike
            assert all(kept.count(x) == whole.count(x) for x in set(kept)), name


def test_every_module_states_its_cases():
    from quillsearch.llm import bpe, chat, exact, huffman, packing, phrases, quality, simhash, toxicity, urls

    for module in (bpe, chat, exact, huffman, packing, phrases, quality, simhash, toxicity, urls, corpus_pipeline):
        said = " ".join(module.__doc__.split())
        for case in ("null", "empty", "repeated", "any length" if module is not packing else "longer than", "empty table", "names"):
            assert case in said or (module is corpus_pipeline and case in ("repeated", "any length")), (module.__name__, case)
    assert all(stage.__doc__ for _, stage in corpus_pipeline.STAGES)


def test_registered():
    names = queries.queries()
    assert [n for n in names if n != "pipeline"] == sorted((n for n in names if n != "pipeline"), key=lambda n: int(n[2:].split("_")[0]))
    assert len(names) == 11 and set(queries.oracle_sql()) < set(names)


def test_the_rest_does_without(tmp_path):
    """The entry imports with the subpackage and the pipeline deleted."""
    import shutil

    shutil.copytree(ROOT / "quillsearch", tmp_path / "quillsearch", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'lexical_search' in e.queries() and len(e.oracle_sql()) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
