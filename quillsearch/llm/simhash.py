"""SimHash near-duplicates by anchor-point covering.

A text has a 46-bit SimHash of its words (weights 1 + log2 of the count, in
whole steps) and a 128-bit SimHash of its word bigrams, in two halves.  Two texts
are near copies if the first differ in at most ``2 * THRESHOLD`` bits and the
second in at most ``BOTH_BITS``, of them ``CHECK_BITS`` in the first half; groups
are the connected components.

Candidates come from a covering code: the direct sum of two binary Golay codes,
each perfect with covering radius 3, gives 2**24 anchors.  A fingerprint is
replicated to every anchor whose distance exceeds the covering radii, summed
over the blocks, by at most THRESHOLD.  Take two fingerprints that differ in at
most 2 * THRESHOLD bits: a point halfway is within THRESHOLD of both, so its
nearest anchor has both.  That search is exact, and each pair is accepted at
that one anchor alone.  Equal fingerprints are one node, so copies cost nothing,
and a bucket passes on only a spanning forest of its accepted pairs.

The bigrams are a second filter on the pairs found: copies with many words changed
may pass the first test and fail here (the README has recall by similarity).

Defined cases: a null text is a group of its own; texts without words (empty,
punctuation) group only when equal; a one-word text uses the word for bigrams
too; texts of any length are read whole and no weight is capped; a group is named
by its least doc_id (nulls last) and keeps exactly one row, the first of that id;
groups without ids have a null group_id, and groups that share their least doc_id
share its name, but each keeps its row; repeated rows are copies; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, tools
from .tools import cut, over_text, parts, text_key

#: Reach of the replication beyond the covering radius.
THRESHOLD = 3
#: Most bits in which the bigram fingerprints of near copies differ, in the first half and
#: in both.  Half a fingerprint can't part changed copies from unrelated texts (some 28 bits
#: apart there); both halves do: of 43 million pairs of texts no unrelated one within 6 bits
#: came below 43, and of copies with a tenth of their words changed within 6 bits 99 % stay.
CHECK_BITS, BOTH_BITS = 22, 38
BLOCK, RADIUS = 23, 3
#: A cell of the anchor space, one task's work, is for so many nodes (some 1.5 million replicas, under 100 MB).
CELL_NODES = 5000
#: Buckets of more rows are compared in tiles of so many rows and columns (2 MB).
CROWD, TILE = 256, (64, 4096)
#: Replicas of a cell that are compared at a time (some 200 MB); fuller cells take several turns.
TURN = 1 << 21
_LANES = np.uint64(0x0101010101010101)


def simhash(hashes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit SimHash per owner; weights are whole numbers from 1.

    Bits are counted eight at a time in the bytes of a word: sixteen features of
    weights up to 15 can't overflow a byte, so only every sixteenth row is widened.
    A greater weight is several rows."""
    out = np.zeros(n, dtype=np.uint64)
    if len(hashes) == 0:
        return out
    if int(weight.max()) > 15:
        times = -(-weight.astype(np.int64) // 15)
        last = np.cumsum(times) - 1
        rest = (weight - np.uint64(15) * (times - 1).astype(np.uint64)).astype(np.uint64)
        hashes, owner, weight = np.repeat(hashes, times), np.repeat(owner, times), np.full(int(times.sum()), 15, dtype=np.uint64)
        weight[last] = rest
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
    piece = np.flatnonzero(within % 16 == 0)
    group = np.searchsorted(piece, begin)
    half = np.add.reduceat(weight.astype(np.int64), begin)
    for lane in range(8):
        ones = np.add.reduceat(((hashes >> np.uint64(lane)) & _LANES) * weight, piece)
        count = np.add.reduceat(ones.view(np.uint8).reshape(-1, 8).astype(np.int64), group, axis=0)
        bits = (2 * count > half[:, None]).astype(np.uint64)
        for byte in range(8):
            out[owner[begin]] |= bits[:, byte] << np.uint64(8 * byte + lane)
    return out


def fingerprints(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 46-bit word SimHash and the first half of the bigram SimHash of each text."""
    return signatures(raw, at)[:2]


def signatures(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 46-bit word SimHash and both halves of the bigram SimHash of each text."""
    n = len(at) - 1
    h, first = kernels.words(raw, at)
    owner = kernels.owners(first)
    bare = np.flatnonzero(np.diff(first) == 0)
    whole = kernels.run_hashes(raw, at[bare], np.maximum(at[bare + 1], at[bare]), kernels._RAW) if len(raw) and len(bare) and (np.diff(at)[bare] > 0).all() else None
    lone = np.zeros(len(bare), dtype=np.uint64)
    if len(bare):
        if whole is not None:
            lone = whole
        else:
            full = np.diff(at)[bare] > 0
            if full.any():
                lone[full] = kernels.run_hashes(raw, at[bare[full]], at[bare[full] + 1], kernels._RAW)
        lone = kernels.mix(lone + np.uint64(0xABCDEF))
    salt = kernels.mix(owner.astype(np.uint64))
    _, index, count = np.unique(h ^ salt, return_index=True, return_counts=True)
    order = np.argsort(index)
    index, count = index[order], count[order]
    weight = (1 + np.floor(np.log2(count))).astype(np.uint64)
    words = simhash(h[index], owner[index], weight, n)
    lead = np.concatenate([[np.uint64(1)], h[:-1]]) if len(h) else h
    lead[first[:-1][np.diff(first) > 0]] = np.uint64(1)
    pairs = kernels.mix(lead * np.uint64(0x9E3779B97F4A7C15) + h)
    once = np.ones(len(h), dtype=np.uint64)
    check = simhash(pairs, owner, once, n)
    more = simhash(kernels.mix(pairs ^ np.uint64(0x5BD1E995)), owner, once, n)
    words[bare], check[bare] = lone, kernels.mix(lone)
    more[bare] = kernels.mix(check[bare])
    return words & np.uint64((1 << 2 * BLOCK) - 1), check, more


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of all 23-bit words' halves, the coset leaders, and per syndrome
    its patterns of up to RADIUS + THRESHOLD bits in order of excess, with starts.

    Returns (syndrome of the low 12 bits, of the high 11 bits), leaders,
    patterns, and starts of shape (2048, THRESHOLD + 2)."""
    poly = 0b110001110101

    def remainder(x: int) -> int:
        for bit in range(BLOCK - 1, 10, -1):
            if x >> bit & 1:
                x ^= poly << (bit - 11)
        return x

    column = np.array([remainder(1 << b) for b in range(BLOCK)], dtype=np.uint32)
    word = np.arange(1 << 12, dtype=np.uint32)
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for b in range(12):
        low ^= np.where(word >> b & 1, column[b], 0).astype(np.uint32)
    for b in range(11):
        high ^= np.where(word[: 1 << 11] >> b & 1, column[12 + b], 0).astype(np.uint32)
    every = np.arange(1 << BLOCK, dtype=np.uint32)
    size = np.bitwise_count(every)
    every = every[size <= RADIUS + THRESHOLD]
    excess = np.maximum(np.bitwise_count(every).astype(np.int64) - RADIUS, 0)
    syndrome = low[every & 0xFFF] ^ high[every >> 12]
    order = np.lexsort((every, excess, syndrome))
    every, key = every[order], (syndrome * (THRESHOLD + 2) + excess)[order]
    starts = np.searchsorted(key, np.arange(2048)[:, None] * (THRESHOLD + 2) + np.arange(THRESHOLD + 2))
    leaders = every[starts[:, 0]]
    return np.stack([low, np.concatenate([high, high])]), leaders, every, starts


def syndrome(block: np.ndarray) -> np.ndarray:
    table = golay()[0]
    return table[0][block & 0xFFF] ^ table[1][block >> 12]


def nearest(fp: np.ndarray) -> np.ndarray:
    """The anchor nearest to each fingerprint, as its 46-bit code word."""
    leaders = golay()[1]
    mask = np.uint64((1 << BLOCK) - 1)
    a, b = (fp & mask).astype(np.uint32), (fp >> np.uint64(BLOCK)).astype(np.uint32)
    return (a ^ leaders[syndrome(a)]).astype(np.uint64) | (b ^ leaders[syndrome(b)]).astype(np.uint64) << np.uint64(BLOCK)


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors in reach: index into fp, and the anchor's code word."""
    _, _, patterns, starts = golay()
    mask = np.uint64((1 << BLOCK) - 1)
    a, b = (fp & mask).astype(np.uint32), (fp >> np.uint64(BLOCK)).astype(np.uint32)
    sa, sb = syndrome(a), syndrome(b)
    index, found = [], []
    for i in range(THRESHOLD + 1):
        # excess i in the first block, up to THRESHOLD - i in the second
        from_a, to_a = starts[sa, i], starts[sa, i + 1]
        from_b, to_b = starts[sb, 0], starts[sb, THRESHOLD - i + 1]
        na, nb = to_a - from_a, to_b - from_b
        each = na * nb
        who = np.repeat(np.arange(len(fp)), each)
        place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        pa_, pb_ = place // nb[who], place % nb[who]
        ca = a[who] ^ patterns[from_a[who] + pa_]
        cb = b[who] ^ patterns[from_b[who] + pb_]
        index.append(who)
        found.append(ca.astype(np.uint64) | cb.astype(np.uint64) << np.uint64(BLOCK))
    return np.concatenate(index), np.concatenate(found)


def middle(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A point at most half the distance, rounded up, from either of a pair."""
    low = np.minimum(x, y)
    rest = x ^ y
    for _ in range(THRESHOLD):
        more = np.bitwise_count(rest) > np.bitwise_count(low ^ np.minimum(x, y))
        bit = rest & (~rest + np.uint64(1))
        bit = np.where(more, bit, np.uint64(0))
        low ^= bit
        rest ^= bit
    return low


def one_sided(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each fingerprint may be the lesser, and the greater, that settles a pair at its anchor.

    ``middle`` has its high bits from the lesser and its low bits from the greater of a pair, so
    its second block is the lesser's or its first block is the greater's.  The middle is within
    RADIUS of its anchor in both blocks, and so is that one in that block."""
    away = anchor ^ fp
    return np.bitwise_count(away >> np.uint64(BLOCK)) <= RADIUS, np.bitwise_count(away & np.uint64((1 << BLOCK) - 1)) <= RADIUS


def bucket_edges(anchor: np.ndarray, fp: np.ndarray, check: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the near pairs settled at these anchors.

    Common words pull the fingerprints of a language together, so the pairs of its buckets
    grow with the square of the texts.  They are compared on contiguous arrays: small buckets
    side by side, step by step; those of over CROWD rows in tiles, and only where one of the
    two rows can settle the pair there."""
    order = np.argsort(anchor, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(anchor[order]) != 0])) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(anchor)))
    # the largest bucket first, so that those with pairs at a distance are at the start
    down = np.argsort(-size, kind="stable")
    begin, size = begin[down], size[down]
    start = np.cumsum(size) - size
    order = order[np.repeat(begin - start, size) + np.arange(len(anchor))]
    anchor, fp, check, more = anchor[order], fp[order], check[order], more[order]
    left, right = [], []
    parent = np.arange(len(anchor))

    def roots(v: np.ndarray) -> np.ndarray:
        r = parent[v]
        while not np.array_equal(up := parent[r], r):
            r = up
        parent[v] = r
        return r

    def link(u: np.ndarray, v: np.ndarray) -> bool:
        """Join what is near of pairs within the first bits; whether there was any."""
        half = np.bitwise_count(check[u] ^ check[v])
        hit = np.flatnonzero(half <= CHECK_BITS)
        u, v = u[hit], v[hit]
        hit = half[hit] + np.bitwise_count(more[u] ^ more[v]) <= BOTH_BITS
        u, v = u[hit], v[hit]
        # pairs that are connected already, most of a crowd's, are left out at once
        if len(u):
            hit = roots(u) != roots(v)
            u, v = u[hit], v[hit]
        if len(u):
            hit = nearest(middle(fp[u], fp[v])) == anchor[u]
            u, v = u[hit], v[hit]
        for x, y in zip(u.tolist(), v.tolist()):
            a, b = x, y
            while (up := int(parent[a])) != a:
                a = up
            while (up := int(parent[b])) != b:
                b = up
            if a != b:
                parent[b] = a
                left.append(x)
                right.append(y)
        return len(u) > 0

    def tiles(rows: np.ndarray, columns: np.ndarray, ahead: bool) -> bool:
        """Compare rows with columns of greater place (ahead) or of lesser; whether any were near."""
        met = False
        x = fp[rows][:, None]
        for at in range(0, len(columns), TILE[1]):
            some = columns[at : at + TILE[1]]
            hit = np.flatnonzero(np.bitwise_count(x ^ fp[some]) <= 2 * THRESHOLD)
            if len(hit):
                u, v = rows[hit // len(some)], some[hit % len(some)]
                hit = u < v if ahead else v < u
                met |= link(u[hit], v[hit])
        return met

    crowds = int((size > CROWD).sum())
    for a, n in zip(start[:crowds].tolist(), size[:crowds].tolist()):
        # by fingerprint, so that the lesser of a pair has the lesser place
        inner = a + np.argsort(fp[a : a + n], kind="stable")
        for x in (order, fp, check, more):
            x[a : a + n] = x[inner]
        lesser, greater = one_sided(anchor[a : a + n], fp[a : a + n])
        every = np.arange(a, a + n)
        root, most = every, -1
        for ahead, rows, columns in ((True, every[lesser], every), (False, every[greater], every[~lesser])):
            for k in range(0, len(rows), TILE[0]):
                now = rows[k : k + TILE[0]]
                some = columns[np.searchsorted(columns, now[0], "right") :] if ahead else columns[: np.searchsorted(columns, now[-1])]
                # rows of a component that has much of the bucket needn't meet its other rows
                own = root[now - a] == most
                met = tiles(now[~own], some, ahead) if not own.all() else False
                if own.any():
                    met |= tiles(now[own], some[root[some - a] != most], ahead)
                if met:
                    root = roots(every)
                    count = np.bincount(root - a)
                    most = a + int(count.argmax()) if count.max() > n // 4 else -1
    first = int(size[:crowds].sum())
    for step in range(1, int(size[crowds:].max(initial=1))):
        # the buckets of more rows than the step; some of the pairs are of two buckets
        last = int(size[: np.searchsorted(-size, -step)].sum())
        near = first + np.flatnonzero(np.bitwise_count(fp[first : last - step] ^ fp[first + step : last]) <= 2 * THRESHOLD)
        near = near[anchor[near] == anchor[near + step]]
        if len(near):
            link(near, near + step)
    return order[np.array(left, dtype=np.int64)], order[np.array(right, dtype=np.int64)]


def turns(info: np.ndarray, most: int = TURN) -> Iterator[np.ndarray]:
    """Places of the replicas at these anchors, in parts of about so many; an anchor's are in one part."""
    times = max(1, -(-len(info) // most))
    part = (kernels.mix(np.arange(4096, 8192)) % np.uint64(times)).astype(np.uint16)[info >> np.uint32(12)]
    for k in range(times):
        yield np.flatnonzero(part == k)


def name(fp: np.ndarray, check: np.ndarray, more: np.ndarray) -> np.ndarray:
    """A node's 64-bit name, from all its fingerprints."""
    return kernels.mix(kernels.mix(kernels.mix(fp) + check) + more).view(np.int64)


def near_edges(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct nodes (node, fp, chk, more) that are near copies.

    Replicas travel as packed blocks, one per target cell of the anchor space,
    not as single rows."""
    cells = max(parts(nodes.sparkSession), -(-nodes.count() // CELL_NODES))
    # cells follow the first block's anchor, of which a fingerprint has few; where
    # there are many cells the second block's divides them further
    fine = -(-cells // 4096) if cells > 2048 else 1
    coarse = 4096 if cells > 2048 else cells
    cells = coarse * fine

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                fp, check, more = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("fp", "chk", "more"))
                who, anchor = anchors(fp)
                info = compact(anchor)
                lead = info & np.uint32(0xFFF)
                lead = lead.astype(np.uint64) if coarse == 4096 else kernels.mix(lead) % np.uint64(coarse)
                cell = lead * np.uint64(fine) + kernels.mix(info >> np.uint32(12)) % np.uint64(fine)
                order = np.lexsort((who, cell))
                who, info, cell = who[order], info[order], cell[order].astype(np.int32)
                three = np.ascontiguousarray(info.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
                first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                # a block: its fingerprints, the number of anchors of each, and the anchors in three bytes
                blobs = []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(cell)], strict=False):
                    row, count = np.unique(who[a:b], return_counts=True)
                    blobs.append(np.int32(len(row)).tobytes() + fp[row].tobytes() + check[row].tobytes() + more[row].tobytes() + count.astype(np.uint16).tobytes() + three[a:b].tobytes())
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell[first]), "block": pa.array(blobs, pa.binary())})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, check, more, count, three = [], [], [], [], []
        for batch in batches:
            for blob in batch.column("block"):
                data = blob.as_buffer()
                n = int(np.frombuffer(data, np.int32, 1)[0])
                fp.append(np.frombuffer(data, np.uint64, n, 4))
                check.append(np.frombuffer(data, np.uint64, n, 4 + 8 * n))
                more.append(np.frombuffer(data, np.uint64, n, 4 + 16 * n))
                count.append(np.frombuffer(data, np.uint16, n, 4 + 24 * n))
                three.append(np.frombuffer(data, np.uint8, -1, 4 + 26 * n))
        if not fp:
            return
        fp, check, more, count, three = map(np.concatenate, (fp, check, more, count, three))
        whose = np.repeat(np.arange(len(fp), dtype=np.int32), count)
        info = np.zeros(len(whose), dtype=np.uint32)
        for byte in range(3):
            info |= three[byte::3].astype(np.uint32) << np.uint32(8 * byte)
        node = name(fp, check, more)
        for own in turns(info):
            who = whose[own]
            a, b = bucket_edges(expand(info[own]), fp[who], check[who], more[who])
            a, b = node[who[a]], node[who[b]]
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    blocks = nodes.select("fp", "chk", "more").repartition(cells).mapInArrow(scatter, "cell int, block binary")
    return blocks.repartitionById(cells, "cell").mapInArrow(meet, "a long, b long")


def compact(word: np.ndarray) -> np.ndarray:
    """A code word's 24 information bits: the code is systematic in its high bits."""
    mask = np.uint64((1 << BLOCK) - 1)
    return ((word & mask) >> np.uint64(11) | (word >> np.uint64(BLOCK + 11)) << np.uint64(12)).astype(np.uint32)


@cache
def _codewords() -> np.ndarray:
    info = np.arange(1 << 12, dtype=np.uint32) << 11
    return (info ^ syndrome(info)).astype(np.uint64)


def expand(info: np.ndarray) -> np.ndarray:
    book = _codewords()
    return book[info & 0xFFF] | book[info >> 12] << np.uint64(BLOCK)


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root: the least node of each connected component.

    Alternating large-star and small-star rounds, each checkpointed, until the
    stars stand still.  A hub's least neighbour is aggregated before the edges meet
    it, so no task has to hold a star and a skewed join may be split."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("a <> b").distinct())
    old = state(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: from each vertex to its lesser neighbours
        down = large.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        lowest = down.groupBy("v").agg(F.min("u").alias("m"))
        small = down.join(lowest, "v").select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        edges = cut(small)
        now = state(edges)
        if now == old:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        old = now


def first_rows(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Columns node, first: the first row of each node's group, as a struct (none, doc_id,
    node, row), for nodes that have several rows or are in a component; the others are alone.

    ``nodes`` has node, first, n; it is marked for broadcast if it is small."""
    every = roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))
    linked = cut(nodes.select("node", "first", "n").join(every, "node", "left").where("n > 1 OR root IS NOT NULL"))
    whole = linked.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("first"))
    members = linked.where("root IS NOT NULL").select("node", "root").join(whole, "root").select("node", "first")
    return tools.checked_broadcast(members.unionByName(linked.where("root IS NULL").select("node", "first")), 4)


def first_of() -> Column:
    """The first row of a node: by doc_id, nulls last; rows of one id by their place."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "row")).alias("first")


def marked(documents: DataFrame, keyed: bool = False) -> DataFrame:
    """Narrow rows (doc_id, fp, chk, more, node) with the fingerprints of each text; text_key if keyed.

    A null text has no node."""
    also = ("doc_id", "text_key") if keyed else ("doc_id",)
    key = [text_key(F.col("text")).alias("text_key")] if keyed else []

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        fp, check, more = signatures(raw, at)
        node = pa.array(name(fp, check, more), mask=np.asarray(batch.column("text").is_null()))
        return {c: batch.column(c) for c in also} | {"fp": fp.view(np.int64), "chk": check.view(np.int64), "more": more.view(np.int64), "node": node}

    schema = f"doc_id long, {'text_key binary, ' if keyed else ''}fp long, chk long, more long, node long"
    return over_text(documents.select("doc_id", "text", *key), schema, work, also=also)


def groups(documents: DataFrame, keyed: bool = True) -> DataFrame:
    """Columns doc_id, group_id, keep: one row per row of documents.

    If keyed, text_key too, by which ``tools.keep_rows`` finds the rows again."""
    also = ["text_key"] if keyed else []
    # the row numbers are written with the rows, so they stay what they are
    rows = cut(marked(documents, keyed).withColumn("row", F.monotonically_increasing_id()))
    nodes = cut(rows.where(F.col("node").isNotNull()).groupBy("node", "fp", "chk", "more").agg(first_of(), F.count("*").alias("n")))
    named = rows.join(first_rows(nodes, components(near_edges(nodes))), "node", "left")
    group_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    keep = F.col("first").isNull() | (F.col("row") == F.col("first.row"))
    return named.select("doc_id", group_id.alias("group_id"), keep.alias("keep"), *also)
