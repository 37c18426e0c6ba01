"""BPE, Huffman output and packing."""

import base64
import random

import duckdb
import numpy as np
import pytest

from quillsearch.llm import bpe, huffman, packing

from . import brute
from .conftest import CLASH, ODD

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WEIRD = ["'", "don't we'll they've 's x's!'t 'tis I'd've", "a \n b\n\n c  ", "é'm ok 'RE", "你好，世界 123abc 4५६", "a b 　c", "ab" * 300 + " " * 70, "😀😀 ok'll", " 's", "\t'tx", "l'l'll", "<|endoftext|>", "a" * 5000 + " " + "é" * 3000]


@pytest.fixture(scope="module")
def plain():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("ab's tdrevlm\n  é1!ß中") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [*ODD, *WEIRD, *made]


def test_bpe(documents, plain):
    every = texts()
    d = documents(every, extra=CLASH)
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(d).collect()}
    for i, t in enumerate(every):
        assert got[i] == plain.encode_ordinary(t or ""), repr(t)[:80]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(d)).collect()}
    assert back == {i: t or "" for i, t in enumerate(every)}
    assert all(r["exact"] for r in bpe.encode_and_check(d).select("exact").collect())


def test_bpe_forgets_and_goes_on(plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    made = bpe.Encoder(bpe.read(bpe.VOCABULARY))
    for t in ("one two three four five six seven", "eight nine ten", "one two"):
        ids, _ = made.encode(*brute.split([t]))
        assert ids.tolist() == plain.encode_ordinary(t)


SWAPPED = ["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, "!" * 4096 + "?" * 4096, "?" * 4096 + "!" * 4096]


def test_blocks_that_change_places(documents, plain):
    """Long runs of the same bytes in another order are other pieces."""
    got = {r["doc_id"]: r for r in bpe.encode_and_check(documents(SWAPPED)).collect()}
    for i, t in enumerate(SWAPPED):
        assert got[i]["exact"] and got[i]["ids"] == plain.encode_ordinary(t)
    out = huffman.encode_and_check(documents(SWAPPED))
    assert {r["doc_id"]: r["ids"] for r in huffman.decode(out, huffman.stored_lengths(out)).collect()} == {i: r["ids"] for i, r in got.items()}


def test_pieces_of_one_name(plain, monkeypatch):
    """Pieces are compared by their bytes, so names that clash change nothing."""
    monkeypatch.setattr(bpe, "names", lambda raw, start, size, told: size.astype(np.uint64) % np.uint64(3))
    made = bpe.Encoder(bpe.read(bpe.VOCABULARY))
    text = "some words of several lengths, incomprehensibilities, " + "x" * 40 + " " + "y" * 40 + " and " + "x" * 20 + "z" + "x" * 19
    for t in (text, text[::-1], text):
        assert made.encode(*brute.split([t]))[0].tolist() == plain.encode_ordinary(t)


def test_bpe_empty_and_unknown(documents, spark):
    assert bpe.encode(documents([])).count() == 0
    made = bpe.encoder()
    with pytest.raises(ValueError):
        made.decode(np.array([10**6]), np.array([0, 1]))
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect() == [(1, None), (2, "")]


def test_tree_of_lists_equals_tree_of_arrays(plain):
    made = bpe.Encoder(bpe.read(bpe.VOCABULARY))
    for piece in (b" thetheatheon" * 5, b"aaaaaaaaaaaa", b"x"):
        assert made.merge_one(np.frombuffer(piece, np.uint8)) == plain.encode_ordinary(piece.decode())


def least_cost(counts, limit):
    """Cheapest code lengths by trying all multisets of lengths that fit."""
    from itertools import combinations_with_replacement

    n = len(counts)
    order = sorted(counts, reverse=True)
    return min(sum(a * b for a, b in zip(order, lengths)) for lengths in combinations_with_replacement(range(1, limit + 1), n) if sum(2.0**-x for x in lengths) <= 1)


def test_code_lengths():
    rng = np.random.default_rng(0)
    for _ in range(40):
        counts = rng.integers(1, 60, rng.integers(2, 7))
        for limit in (3, 4, 6):
            got = huffman.code_lengths(counts, limit)
            assert got.max() <= limit and (got * counts).sum() == least_cost(counts.tolist(), limit)
    assert huffman.code_lengths(np.array([0, 5, 0])).tolist() == [0, 1, 0]
    assert huffman.code_lengths(np.zeros(3)).tolist() == [0, 0, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_codes_are_canonical():
    lengths = huffman.code_lengths(np.array([9, 1, 4, 4, 2]))
    codes = huffman.canonical(lengths)
    words = [format(int(c), f"0{n}b") for c, n in zip(codes, lengths)]
    assert sorted(words, key=lambda w: (len(w), w)) == [w for _, _, w in sorted((n, i, w) for i, (n, w) in enumerate(zip(lengths, words)))]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_huffman_round_trip(documents):
    every = texts()
    d = documents(every, extra=CLASH)
    coded, lengths = huffman.encode(d)
    rows = {r["doc_id"]: r for r in coded.collect()}
    want = {r["doc_id"]: r["ids"] for r in bpe.encode(d).collect()}
    assert {r["doc_id"]: r["ids"] for r in huffman.decode(coded, lengths).collect()} == want
    codes = huffman.canonical(lengths)
    for i, r in rows.items():
        bits = "".join(format(int(codes[k]), f"0{lengths[k]}b") for k in want[i])
        assert r["data"] == int((bits + "0" * (-len(bits) % 8)) or "0", 2).to_bytes(len(r["data"]), "big") if bits else r["data"] == b""
        assert len(r["checkpoints"]) == -(-len(want[i]) // huffman.BLOCK)
    # a block by itself
    r = max(rows.values(), key=lambda r: r["n_ids"])
    codec = huffman.Codec(lengths)
    one = codec.decode(np.frombuffer(r["data"], np.uint8), np.array([0, len(r["data"])]), np.array(r["checkpoints"][1:2]), np.array([0, 1]), np.array([huffman.BLOCK]))
    assert one.tolist() == want[r["doc_id"]][huffman.BLOCK : 2 * huffman.BLOCK]


def test_huffman_result_can_be_decoded(spark, documents, tmp_path):
    """From the registered query's rows alone, written and read again."""
    from quillsearch.llm import queries

    every = texts()
    documents(every, extra=CLASH).write.parquet(f"{tmp_path}/documents.parquet")
    queries.queries()["op10_huffman"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == len(every) and out.where("exact").count() == len(every)
    want = {r["doc_id"]: r["ids"] for r in bpe.encode(documents(every)).collect()}
    assert {r["doc_id"]: r["ids"] for r in huffman.decode(out, huffman.stored_lengths(out)).collect()} == want
    assert huffman.encode_and_check(documents([])).count() == 0
    assert len(huffman.stored_lengths(huffman.encode_and_check(documents([])))) == 1


def test_huffman_few(documents):
    coded, lengths = huffman.encode(documents([]))
    assert coded.count() == 0
    coded, lengths = huffman.encode(documents(["a", "a", None]))
    assert [(r["n_ids"], bytes(r["data"])) for r in coded.orderBy("doc_id").collect()] == [(1, b"\0"), (1, b"\0"), (0, b"")]
    with pytest.raises(ValueError):
        huffman.Codec(lengths).encode(np.array([0]), np.array([0, 1])) if lengths[0] == 0 else pytest.fail()


def test_bounds():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(0, 40, rng.integers(1, 60)).tolist()
        size, count = np.unique(lengths, return_counts=True)
        for k in (1, 2, 3, 8):
            assert packing.bounds(size, count, k) == brute.least_bounds(lengths, k)
    assert packing.bounds(np.zeros(0), np.zeros(0)) == []


def test_pack(documents):
    rng = np.random.default_rng(2)
    every = [*ODD, *(" ".join("w" * n) for n in rng.integers(1, 90, 150).tolist())]
    ids = [None, *range(1, len(every) - 1), 1]
    for budget in (64, packing.TOKEN_BUDGET):
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["bucket"], r["batch"]) for r in packing.pack(documents(every, ids, CLASH), budget=budget).collect())
        assert got == brute.packed(list(zip(ids, every)), budget=budget)
    assert packing.pack(documents([])).count() == 0


def test_pack_oracle(documents):
    for every in (["a b", "c", None, "d e f", "g g"], [*ODD, *(" ".join("w" * n) for n in range(1, 60))]):
        d = documents(every).toPandas()  # noqa: F841 - read by DuckDB
        con = duckdb.connect()
        con.register("documents", d)
        want = sorted(con.execute(packing.oracle()).fetchall())
        assert sorted(tuple(r) for r in packing.pack(documents(every)).collect()) == want
