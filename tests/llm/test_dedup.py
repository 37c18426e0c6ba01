import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsearch.llm import exact, phrases, simhash, tools

from . import brute
from .conftest import CLASH, ODD

SF = "/root/testdata/sf0.001"


def test_exact(documents):
    texts = [*ODD, "a" * 64 + "x", "a" * 64 + "y", "a" * 64 + "x"]
    got = {r["doc_id"]: r for r in exact.groups(documents(texts, extra=CLASH)).collect()}
    for i, t in enumerate(texts):
        same = [k for k, u in enumerate(texts) if u == t] if t is not None else [i]
        assert (got[i]["group_id"], got[i]["copies"], got[i]["keep"]) == (same[0], len(same), i == same[0])


def test_exact_repeats_and_nulls(documents):
    rows = exact.groups(documents(["x", "x", "x"], [5, 5, None])).collect()
    assert sorted((r["keep"], r["group_id"], r["copies"]) for r in rows) == [(False, 5, 3), (False, 5, 3), (True, 5, 3)]
    assert exact.groups(documents([])).count() == 0


def test_exact_beyond_broadcast(documents, monkeypatch):
    monkeypatch.setattr(tools, "BROADCAST_ROWS", 0)
    test_exact(documents)


SWAPPED = ["!" * 4096 + "?" * 4096, "?" * 4096 + "!" * 4096, "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096]


@pytest.mark.parametrize("op", (exact, simhash, phrases))
def test_blocks_that_change_places(documents, op):
    assert dict(op.groups(documents(SWAPPED)).select("doc_id", "group_id").collect()) == {0: 0, 1: 1, 2: 2, 3: 3}


def shuffled_texts(df):
    """Exchanges of the plan that move a column named text."""
    tree = df._jdf.queryExecution().executedPlan().toString()
    out, lines = [], tree.split("\n")
    for k, line in enumerate(lines):
        if re.search(r"\bExchange\b", line) and "BroadcastExchange" not in line:
            below = next((x for x in lines[k + 1 :] if "Project" in x or "Scan" in x), "")
            out += [below] if re.search(r"\btext#", below.split("Batched")[0]) else []
    return out


@pytest.mark.parametrize("most", (tools.BROADCAST_ROWS, 0))
@pytest.mark.parametrize("op", (exact, simhash, phrases))
def test_texts_are_not_shuffled(spark, monkeypatch, op, most):
    """Whatever the number of keys; every checkpointed part is seen as it is made."""
    monkeypatch.setattr(tools, "BROADCAST_ROWS", most)
    seen, plain = [], tools.cut
    for module in (tools, exact, simhash, phrases):
        monkeypatch.setattr(module, "cut", lambda df: (seen.append(df), plain(df))[1])
    seen.append(op.groups(spark.read.parquet(f"{SF}/documents.parquet")))
    assert len(seen) > 3 and not [x for df in seen for x in shuffled_texts(df)]


@pytest.mark.parametrize("n", (1, 300, 5000))
def test_key_filter(spark, n, monkeypatch):
    """No key is lost, and few others pass until the filter is full."""
    frame = spark.range(n).select(F.xxhash64("id").alias("hash"))
    other = spark.range(10**6, 10**6 + 4000).select(F.xxhash64("id").alias("hash"))
    for bits in (tools.FILTER_BITS, 1 << 16):
        monkeypatch.setattr(tools, "FILTER_BITS", bits)
        maybe = tools.key_filter(frame, n)
        assert frame.where(maybe(F.col("hash"))).count() == n
        assert other.where(maybe(F.col("hash"))).count() < (400 if bits > 1 << 16 or n < 5000 else 1000)


@pytest.mark.parametrize("op", (exact, simhash, phrases))
def test_ids_that_clash(documents, op):
    """Groups that share their least id, or have none, share its name; empty texts are copies."""
    one, two, three = ("red fox runs over hills", "quiet rivers carry cold stones", "seven old clocks strike noon")
    rows = op.groups(documents([one, two, three, None, "", "", one], [5, 5, None, None, 8, 9, 3], extra=CLASH)).select("doc_id", "group_id").collect()
    assert sorted(tuple(r) for r in rows if r[0] is not None) == [(3, 3), (5, 3), (5, 5), (8, 8), (9, 8)]
    assert [r[1] for r in rows if r[0] is None] == [None, None]


def test_keep_rows(documents):
    d = documents(["x", "x", "y", "x", None], [1, 1, 2, 3, None], extra=CLASH)
    left = tools.keep_rows(d, exact.groups(d))
    assert left.columns == d.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, ""), (1, "x"), (2, "y")]


@pytest.mark.parametrize("op", (exact, simhash))
@pytest.mark.parametrize("most", (tools.BROADCAST_ROWS, 0))
def test_keep_rows_of_shared_ids(documents, monkeypatch, op, most):
    """Decisions are for rows: texts under one id, or without ids, stay once each."""
    monkeypatch.setattr(tools, "BROADCAST_ROWS", most)
    one, two, three = ("red fox runs over hills", "quiet rivers carry cold stones", "seven old clocks strike noon")
    d = documents([one, one, two, three, two, None, None, three, one], [None, None, None, None, None, None, 3, 5, 5], extra=CLASH)
    left = tools.keep_rows(d, op.groups(d))
    assert left.columns == d.columns
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert got == sorted([(5, one), (0, two), (5, three), (0, ""), (3, "")])


def test_golay_code():
    low, leaders, _, _ = simhash.golay()
    assert np.bitwise_count(leaders).max() == simhash.RADIUS  # the code is perfect
    book = simhash._codewords()
    assert len(set(book.tolist())) == 4096 and np.bitwise_count(book[1:]).min() == 7
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 1 << 46, 50).astype(np.uint64)
    who, anchor = simhash.anchors(fp)
    assert np.array_equal(simhash.expand(simhash.compact(anchor)), anchor)
    mask = np.uint64((1 << 23) - 1)
    for i in range(50):
        # every anchor within reach, by brute force over both blocks
        excess = [np.maximum(np.bitwise_count(book ^ x).astype(int) - 3, 0) for x in (fp[i] & mask, fp[i] >> np.uint64(23))]
        assert (who == i).sum() == (excess[0][:, None] + excess[1][None, :] <= simhash.THRESHOLD).sum()


def test_pairs_meet_once():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 46, 500).astype(np.uint64)
    y = x.copy()
    for i in range(500):
        for b in rng.choice(46, rng.integers(1, 7), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    home = simhash.nearest(simhash.middle(x, y))
    assert np.array_equal(home, simhash.nearest(simhash.middle(y, x)))
    for fp in (x, y):
        who, anchor = simhash.anchors(fp)
        have = set(zip(who.tolist(), anchor.tolist()))
        assert all((i, int(home[i])) in have for i in range(500))


def test_fingerprints_by_plain_python():
    texts = [*ODD[:-4], "a b c d e f g h", "A B C D E F G H", "x " * 20, "word " * 40_000 + "other", *SWAPPED]
    fp, check, more = simhash.signatures(*brute.split(texts))
    for i, t in enumerate(texts):
        assert (int(fp[i]), int(check[i]), int(more[i])) == brute.fingerprint(t), repr(t)[:60]


def test_bucket_edges_connect_what_is_near():
    """A spanning forest of exactly the accepted pairs, in crowds and apart."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 46, 5).astype(np.uint64)
    fp = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 46, 60).astype(np.uint64)) for b in base])
    check, more = np.repeat(base, 60), np.repeat(base, 60)
    who, anchor = simhash.anchors(fp)
    a, b = simhash.bucket_edges(anchor, fp[who], check[who], more[who])
    got = brute.roots(300, zip(who[a].tolist(), who[b].tolist()))
    near = [(i, j) for i in range(300) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 6 and i // 60 == j // 60]
    assert got == brute.roots(300, near)
    assert not {(i // 60, j // 60) for i, j in zip(who[a].tolist(), who[b].tolist())} - {(k, k) for k in range(5)}


@pytest.mark.parametrize("crowd, tile", ((1, (2, 3)), (1, (64, 4096)), (20, (3, 50)), (10**9, (1, 1))))
def test_crowded_buckets(monkeypatch, crowd, tile):
    """Tiles and steps connect what all pairs within the bits connect, each settled pair at one anchor."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(10)
    fp = np.repeat(rng.integers(0, 1 << 46, 4).astype(np.uint64), 70)
    for _ in range(4):
        fp ^= np.where(rng.random(280) < 0.6, np.uint64(1) << rng.integers(0, 46, 280).astype(np.uint64), np.uint64(0))
    # some like most of their crowd, some like few
    check = rng.integers(0, 1 << 63, 9).astype(np.uint64)[np.where(np.arange(280) % 5 < 3, 0, rng.integers(0, 9, 280))]
    more = check
    who, anchor = simhash.anchors(fp)
    a, b = simhash.bucket_edges(anchor, fp[who], check[who], more[who])
    near = [(i, j) for i in range(280) for j in range(i) if int(fp[i] ^ fp[j]).bit_count() <= 6 and check[i] == check[j]]
    assert brute.roots(280, zip(who[a].tolist(), who[b].tolist())) == brute.roots(280, near)
    assert {tuple(sorted(p)) for p in zip(who[a].tolist(), who[b].tolist())} <= {(j, i) for i, j in near}
    assert (anchor[a] == anchor[b]).all() and len(near) > 500


def test_crowd_of_unlike_texts_in_the_time_of_plain_comparisons():
    """A language's common words put many unlike texts around one anchor: some nanoseconds a pair."""
    rng = np.random.default_rng(11)
    n = 12_000
    away = np.packbits(rng.random((6 * n, 64)) < np.where(np.arange(64) < 46, 0.15, 0), axis=1, bitorder="little").view(np.uint64)[:, 0]
    excess = [np.maximum(np.bitwise_count(x).astype(int) - 3, 0) for x in (away & np.uint64((1 << 23) - 1), away >> np.uint64(23))]
    fp = away[excess[0] + excess[1] <= 3][:n]
    assert len(fp) == n
    check, more = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))

    def plain():
        for k in range(0, n, 64):
            np.flatnonzero(np.bitwise_count(fp[k : k + 64, None] ^ fp[k:]) <= 6)

    def fastest(f):
        took = []
        for _ in range(2):
            begin = time.process_time()
            f()
            took.append(time.process_time() - begin)
        return min(took)

    assert fastest(lambda: simhash.bucket_edges(np.zeros(n, np.uint64), fp, check, more)) < 4 * fastest(plain)


def test_turns_keep_anchors_together():
    rng = np.random.default_rng(12)
    info = rng.integers(0, 1 << 24, 5000).astype(np.uint32)
    info = np.concatenate([info, info])
    for most, least in ((10**6, 1), (3000, 4), (100, 50)):
        parts = list(simhash.turns(info, most))
        assert len(parts) >= least and np.array_equal(np.sort(np.concatenate(parts)), np.arange(10_000))
        sets = [set(info[p].tolist()) for p in parts]
        assert sum(map(len, sets)) == len(set(info.tolist())) and max(map(len, parts)) < 3 * most
    assert [len(p) for p in simhash.turns(info[:0])] == [0]


def test_simhash_bits():
    """The lanes count as a plain sum of signed bits does."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    owner = np.sort(rng.integers(0, 5, 400))
    w = rng.integers(1, 40, 400).astype(np.uint64)
    got = simhash.simhash(h, owner, w, 6)
    for k in range(6):
        bits = ((h[owner == k][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int) * 2 - 1
        want = (bits * w[owner == k].astype(int)[:, None]).sum(axis=0) > 0
        assert [int(got[k]) >> b & 1 for b in range(64)] == want.astype(int).tolist()


@pytest.fixture(scope="module")
def near(documents):
    rng = np.random.default_rng(3)
    book = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(60):
        base = list(rng.choice(book, 150))
        texts.append(" ".join(base))
        for _ in range(rng.integers(0, 4)):
            copy = list(base)
            for at in rng.choice(150, 4, replace=False):
                copy[at] = rng.choice(book)
            texts.append(" ".join(copy))
    return texts


def test_simhash_groups(documents, near):
    texts = [*ODD, *near]
    got = {r["doc_id"]: r for r in simhash.groups(documents(texts, extra=CLASH)).collect()}
    want = brute.near_groups(list(enumerate(texts)))
    assert {i: r["group_id"] for i, r in got.items()} == want
    assert {i for i, r in got.items() if r["keep"]} == set(want.values())
    assert len(set(want.values())) < len(texts) - 40  # there were near copies


def test_simhash_repeats(documents):
    d = documents(["same text here now", "same text here now", None, "same text here now"], [4, 4, None, 7])
    assert sorted((r["doc_id"] or 0, r["group_id"] or 0, r["keep"]) for r in simhash.groups(d).collect()) == [(0, 0, True), (4, 4, False), (4, 4, True), (7, 4, False)]
    assert simhash.groups(documents([])).count() == 0


def test_simhash_keeps_one_row_a_component(documents):
    """Null and repeated ids name several groups; each keeps a row of its own."""
    one, two, three = ("red fox runs over hills", "quiet rivers carry cold stones", "seven old clocks strike noon")
    got = simhash.groups(documents([one, two, three, one], [None, None, None, None])).collect()
    assert sorted(r["keep"] for r in got) == [False, True, True, True]
    got = simhash.groups(documents([one, two, three, three, one], [5, 5, None, 7, 5])).collect()
    assert sorted((r["doc_id"] or 0, r["keep"]) for r in got) == [(0, False), (5, False), (5, True), (5, True), (7, True)]


def test_simhash_confirms_changed_copies(documents, spark):
    """By the texts: copies within 6 bits that share half their bigrams are linked, unlike texts are not."""
    rng = np.random.default_rng(5)
    base = [t.split(" ") for (t,) in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("text").distinct().orderBy("text").limit(60).collect() if len(t.split(" ")) > 30]
    book = [w for t in base for w in t]
    texts = []
    for words in base:
        copy = list(words)
        for k in rng.choice(len(copy), max(1, len(copy) // 10), replace=False):
            copy[k] = book[rng.integers(len(book))]
        texts += [" ".join(words), " ".join(copy)]
    fp = simhash.fingerprints(*brute.split(texts))[0]
    bags = [{(a, b) for a, b in zip(["", *w], w)} for w in (brute_words(t) for t in texts)]
    got = dict(simhash.groups(documents(texts)).select("doc_id", "group_id").collect())
    near, far = [], []
    for i in range(len(texts)):
        for j in range(i):
            like = len(bags[i] & bags[j]) / len(bags[i] | bags[j])
            if like >= 0.5 and int(fp[i] ^ fp[j]).bit_count() <= 6:
                near.append(got[i] == got[j])
            elif like < 0.2:
                far.append(got[i] == got[j])
    assert len(near) >= 20 and sum(near) >= 0.97 * len(near)
    assert far and not any(far)


def test_simhash_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert dict(simhash.groups(d).select("doc_id", "group_id").collect()) == brute.near_groups(rows)


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 460)] + [(9, 9)]
    got = dict(simhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = brute.roots(500, edges)
    assert all(got.get(v, v) == want[v] for v in range(500))
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_phrases(words):
    book, now = set(), ()
    for w in words:
        now += (w,)
        if now not in book:
            book.add(now)
            now = ()
    return book


def test_phrases_are_parsed_as_lz78():
    texts = ["a b a b a b a", "a a a a a a a", "", "!!", "x", None, "b a b a " * 40]
    hashes, at = phrases.parse(*brute.split(texts))
    names = {}
    for i, t in enumerate(texts):
        want = plain_phrases((t or "").split()) if t not in ("!!",) else {("!!",)}
        assert at[i + 1] - at[i] == len(want)
        for h, p in zip(sorted(hashes[at[i] : at[i + 1]].tolist()), range(len(want))):
            names.setdefault(h, p)
    # sets of shared phrases intersect alike
    a, b = (set(hashes[at[i] : at[i + 1]].tolist()) for i in (0, 6))
    assert len(a & b) == len(plain_phrases(texts[0].split()) & plain_phrases(texts[6].split()))


def test_phrase_groups(documents, near):
    texts = [*ODD, *near]
    got = dict(phrases.groups(documents(texts, extra=CLASH)).select("doc_id", "group_id").collect())
    sets = [plain_phrases(brute_words(t)) if t else set() for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= phrases.THRESHOLD * len(sets[i] | sets[j])]
    assert len(pairs) > 30
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    apart = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) < 0.3 * len(sets[i] | sets[j])]
    assert not any(got[i] == got[j] for i, j in apart)
    assert got[0] == 0 and got[9] == 9 and got[2] == 2


def brute_words(text):
    import re

    return re.findall(r"[0-9a-z\x80-\xff]+", text.encode().lower().decode("latin-1")) or ([text] if text else [])


def test_phrase_recall_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    got = dict(phrases.groups(d).select("doc_id", "group_id").collect())
    sets = [plain_phrases(brute_words(t)) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= phrases.THRESHOLD * len(sets[i] | sets[j])]
    assert sum(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs) >= 0.9 * len(pairs)
    assert phrases.groups(d.where(F.lit(False))).count() == 0


def test_phrase_groups_by_signatures(spark):
    """The groups are those of all pairs that share a band and are alike, compared one by one."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = phrases.fingerprints(d).collect()
    sign = np.array([np.frombuffer(r["signature"], np.uint8) for r in rows])
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if set(zip(range(phrases.BANDS), rows[i]["bands"])) & set(zip(range(phrases.BANDS), rows[j]["bands"])) and phrases.similarity(sign[i], sign[j]) >= phrases.THRESHOLD]
    root = brute.roots(len(rows), edges)
    least = {r: min(rows[k]["doc_id"] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    assert dict(phrases.groups(d).select("doc_id", "group_id").collect()) == {r["doc_id"]: least[root[k]] for k, r in enumerate(rows)}


def test_minimum_hashes_by_plain_python():
    texts = ["a b a b a c", "red fox runs " * 9, "x"]
    hashes, at = phrases.parse(*brute.split(texts))
    got = phrases.signatures(hashes, at)
    for i in range(len(texts)):
        mine = hashes[at[i] : at[i + 1]].tolist()
        assert got[i].tolist() == [min((h * int(phrases._MULTIPLY[k]) + int(phrases._ADD[k])) % 2**64 for h in mine) for k in range(phrases.HASHES)]


@pytest.mark.parametrize("crowd", (1, 2, 3, 7, 4096))
def test_crowded_bands(spark, crowd):
    """Bands compared block by block connect what they connect whole."""
    rng = np.random.default_rng(6)
    kinds = rng.integers(0, 256, (4, 64)).astype(np.uint8)
    rows = [(i, bytearray(kinds[i % 4].tobytes()), [7, 8 + i % 2, 100 + i]) for i in range(40)]
    got = phrases.alike(spark.createDataFrame(rows, "node long, signature binary, bands array<long>"), crowd=crowd)
    assert brute.roots(40, [tuple(r) for r in got.collect()]) == [i % 4 for i in range(40)]


def test_blocked_has_all_pairs():
    band = np.repeat(np.array([3, 5, 9], dtype=np.int64), [2, 11, 5])
    node = np.arange(18, dtype=np.int64)
    seen = set()
    for key, member, side in phrases.blocked(band, node, 4):
        assert len(key) == len(member) == len(side)
        seen |= {(k, int(m), int(s)) for k, m, s in zip(key.tolist(), member, side)}
    pairs = {(a, b) for k, a, s in seen for l, b, t in seen if k == l and a < b and (s != t or len({u for m, _, u in seen if m == k}) == 1)}
    assert pairs == {(a, b) for a in range(18) for b in range(a + 1, 18) if band[a] == band[b]}


def test_forest():
    key = np.array([1, 1, 1, 1, 2, 3, 3])
    a, b = phrases.forest(key, lambda i, j: np.abs(i - j) != 2)
    assert brute.roots(7, zip(a.tolist(), b.tolist())) == [0, 0, 0, 0, 4, 5, 5]
    assert len(a) == 4
