"""Byte-level BPE encoding and decoding with segment trees over pair ranks.

Texts are cut into pieces by the usual pattern (contractions, letters, digits,
other signs, blanks), computed on whole batches of code points.  Each distinct
piece is encoded once: the leaves of a segment tree hold the ranks of adjacent
pairs, the root yields the leftmost pair of lowest rank, and a merge updates
three leaves, each in logarithmic time, until no pair can be merged.  Short
pieces of like size go through their trees together, a level at a time; long
ones have a tree of their own.

Defined cases: a null text has no ids (an empty list) and decodes to an empty
text; an empty text likewise; unknown ids raise; text is encoded as it is, so
special tokens' names are ordinary text; invalid surrogates cannot occur in Spark
strings; texts of any length are encoded whole, and pieces are told apart by all
their bytes, not by a hash alone; repeated rows and doc_ids are encoded each, null
ones too; an empty table gives no rows; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import kernels
from .tools import over_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longest piece, in bytes, whose trees are run in batches.
BATCHED = 64
#: Distinct pieces that a worker remembers before it forgets them all.
REMEMBERED = 1_000_000
_NONE = np.int64(1 << 62)


@cache
def classes() -> np.ndarray:
    """Per code point: 0 other, 1 letter, 2 number, 3 blank."""
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, every):
            points = [ord(m[0][0]), ord(m[0][-1])]
            if points[1] - points[0] == len(m[0]) - 1:
                out[points[0] : points[1] + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    return out


def pieces(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The starts of all pieces, in code points; texts begin at ``at[:-1]``."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    begin = np.zeros(n + 1, dtype=bool)
    begin[at] = True
    # a run of one class ends where the class or the text changes
    start = begin[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    blank = kind == 3
    last = np.empty(n, dtype=bool)  # last of its run
    last[:-1] = start[1:]
    last[-1] = True
    ends_text = begin[1:].copy()
    ends_text[-1] = True
    # the last blank before other signs leaves its run; a plain space joins what follows
    parted = blank & last & ~ends_text
    start |= parted
    joins = np.zeros(n, dtype=bool)
    joins[1:] = (parted & (points == 32))[:-1]
    start &= ~joins
    # contractions: a lone apostrophe that no space joins takes its letters
    mark = np.flatnonzero((points == 39) & start & last & ~ends_text)
    mark = mark[kind[mark + 1] == 1] if len(mark) else mark
    if len(mark):
        def char(k: int) -> np.ndarray:
            place = np.minimum(mark + k, n - 1)
            inside = (mark + k < n) & (np.searchsorted(at, place, side="right") == np.searchsorted(at, mark, side="right"))
            return np.where(inside, points[place], 0)

        one, two = char(1), char(2)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size = np.where((one == ord(a)) & (two == ord(b)), 2, size)
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        after = mark + 1 + size
        ok = after < n
        start[after[ok]] = True
    return np.flatnonzero(start)


#: Bytes at either end of a piece that tell it apart.
END = 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(END)] + [(1 << 64) - 1], dtype=np.uint64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def ends(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Size, first and last bytes of each piece: up to 16 bytes they are the whole piece."""
    window = np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(END, np.uint8)]), strides=(1,))
    mask = _MASKS[np.minimum(size, END)]
    return np.stack([size.astype(np.uint64), window[start] & mask, window[np.maximum(start + size - END, start)] & mask], axis=1)


def names(raw: np.ndarray, start: np.ndarray, size: np.ndarray, told: np.ndarray) -> np.ndarray:
    """A 64-bit name of each piece; names of pieces under 8 bytes differ among these."""
    out = told[:, 1] ^ told[:, 0] << np.uint64(56)
    big = np.flatnonzero(size >= END)
    if len(big):
        out[big] = kernels.mix(told[big, 1] * np.uint64(0x9E3779B97F4A7C15) + told[big, 2]) ^ told[big, 0]
        long = big[size[big] > 2 * END]
        out[long] ^= kernels.run_hashes(raw, start[long], start[long] + size[long], kernels._RAW)
    return kernels.mix(out)


class Encoder:
    """A vocabulary of token bytes by rank, with what encoding needs."""

    def __init__(self, vocabulary: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.first = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pairs = pairs
        # an open hash table, as numpy gathers: a few probes settle each lookup
        bits = 22
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, -1, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == -1
            _, once = np.unique(slot[left], return_index=True)
            take = np.zeros(len(left), dtype=bool)
            take[once] = True
            take &= free
            self.keys[slot[left[take]]] = keys[left[take]]
            self.ranks[slot[left[take]]] = [pairs[k] for k in keys[left[take]].tolist()]
            left = left[~take]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.known_start, self.known_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        # what a piece is told by: its size, its ends, and where its bytes are kept
        self.told = np.zeros((0, 3), np.uint64)
        self.known_at = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.book = np.zeros(0, np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a large number; negative ids have none."""
        key = a << 32 | b
        slot = self._slot(key)
        out = np.full(len(key), _NONE)
        left = np.flatnonzero((a >= 0) & (b >= 0))
        while len(left):
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def merge_many(self, rows: np.ndarray) -> np.ndarray:
        """Ids of byte rows padded with -1 to a power of two; merged places are -1.

        One segment tree a row, side by side: node k has children 2k, 2k+1, a
        leaf is rank << 8 | place, so the root is the leftmost lowest rank."""
        n, m = rows.shape
        ids = rows.copy()
        after = np.tile(np.arange(1, m + 1), (n, 1))
        before = after - 2
        size = (ids >= 0).sum(axis=1)
        tree = np.full((n, 2 * m), _NONE)
        place = np.arange(m)
        if m > 1:
            r = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, m - 1)
            tree[:, m : 2 * m - 1] = np.where(r < _NONE, r << 8 | place[:-1], _NONE)
        level = m // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)

        def put(who: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = leaf + m
            tree[who, node] = value
            while True:
                node = node >> 1
                if node[0] == 0:
                    break
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])

        while len(live):
            top = tree[live, 1]
            at, rank = top & 255, top >> 8
            nxt = after[live, at]
            beyond = after[live, nxt]
            ids[live, at] = rank
            ids[live, nxt] = -1
            after[live, at] = beyond
            inner = beyond < size[live]
            before[live[inner], beyond[inner]] = at[inner]
            put(live, nxt, np.full(len(live), _NONE))
            right = np.where(inner, ids[live, np.minimum(beyond, m - 1)], -1)
            r = self.rank(rank, right)
            put(live, at, np.where(r < _NONE, r << 8 | at, _NONE))
            prior = before[live, at]
            back = prior >= 0
            if back.any():
                who, p = live[back], prior[back]
                r = self.rank(ids[who, p], rank[back])
                put(who, p, np.where(r < _NONE, r << 8 | p, _NONE))
            live = live[tree[live, 1] < _NONE]
        return ids

    def merge_one(self, piece: np.ndarray) -> list[int]:
        """Ids of one long piece, with a segment tree in plain lists."""
        ids = self.first[piece].tolist()
        n = len(ids)
        m = 1
        while m < n:
            m *= 2
        none, get = 1 << 62, self.pairs.get
        tree = [none] * (2 * m)
        for k in range(n - 1):
            if (r := get(ids[k] << 32 | ids[k + 1])) is not None:
                tree[m + k] = r * m + k
        for k in range(m - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(k: int, value: int) -> None:
            k += m
            tree[k] = value
            while k > 1:
                k >>= 1
                low = tree[2 * k] if tree[2 * k] < tree[2 * k + 1] else tree[2 * k + 1]
                if tree[k] == low:
                    break
                tree[k] = low

        while tree[1] < none:
            rank, at = divmod(tree[1], m)
            nxt = after[at]
            beyond = after[nxt]
            ids[at], ids[nxt] = rank, -1
            after[at] = beyond
            put(nxt, none)
            r = None
            if beyond < n:
                before[beyond] = at
                r = get(rank << 32 | ids[beyond])
            put(at, none if r is None else r * m + at)
            p = before[at]
            if p >= 0:
                r = get(ids[p] << 32 | rank)
                put(p, none if r is None else r * m + p)
        return [i for i in ids if i >= 0]

    def learn(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, told: np.ndarray) -> None:
        """Encode distinct pieces and remember them."""
        order = np.argsort(sizes, kind="stable")
        starts, sizes, hashes, told = starts[order], sizes[order], hashes[order], told[order]
        lists, counts = [self.pool], []
        width = 2
        done = 0
        while done < len(sizes):
            if sizes[done] > BATCHED:
                one = np.array(self.merge_one(raw[starts[done] : starts[done] + sizes[done]]), dtype=np.int32)
                lists.append(one)
                counts.append([len(one)])
                done += 1
                continue
            while width < sizes[done]:
                width *= 2
            end = min(int(np.searchsorted(sizes, width, side="right")), done + (1 << 19) // width)
            span = np.arange(width)
            inside = span < sizes[done:end, None]
            place = np.where(inside, starts[done:end, None] + span, 0)
            ids = self.merge_many(np.where(inside, self.first[raw[place]], -1))
            lists.append(ids[ids >= 0].astype(np.int32))
            counts.append((ids >= 0).sum(axis=1))
            done = end
        size = np.concatenate(counts).astype(np.int64)
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate(lists)
        # bytes are kept of the pieces that their ends don't tell whole
        kept = np.where(sizes > 2 * END, sizes, 0)
        at = len(self.book) + np.cumsum(kept) - kept
        self.book = np.concatenate([self.book, raw[spread(starts, kept)]])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.known_start = np.concatenate([self.known_start, start])[order]
        self.known_size = np.concatenate([self.known_size, size])[order]
        self.known_at = np.concatenate([self.known_at, at])[order]
        self.told = np.concatenate([self.told, told])[order]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and the len+1 offsets of each text's."""
        if len(raw) == 0:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        lead = (raw & 0xC0) != 0x80
        where = np.append(np.flatnonzero(lead), len(raw))  # byte offset of each code point
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        point_at = np.searchsorted(where, at)
        start = where[pieces(points, point_at)]
        size = np.diff(np.append(start, len(raw)))
        told = ends(raw, start, size)
        h = names(raw, start, size, told)
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.forget()
        spot = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(spot, len(self.known) - 1)] != distinct
        if new.any():
            self.learn(raw, start[index[new]], size[index[new]], distinct[new], told[index[new]])
            spot = np.searchsorted(self.known, distinct)
        mine = spot[inverse]
        count, begin, pool = self.known_size[mine], self.known_start[mine], self.pool
        odd = self.unlike(raw, start, size, told, mine)
        if len(odd):
            # other pieces of the same name are encoded by themselves
            own = [np.array(self.merge_one(raw[start[k] : start[k] + size[k]]), dtype=np.int32) for k in odd.tolist()]
            count[odd] = [len(x) for x in own]
            begin[odd] = len(pool) + np.cumsum(count[odd]) - count[odd]
            pool = np.concatenate([pool, *own])
        total = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)]
        return ids, total[np.searchsorted(start, at)]

    def unlike(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, told: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """The pieces that differ from the remembered piece of their name, byte by byte."""
        other = (told != self.told[mine]).any(axis=1)
        long = np.flatnonzero((size > 2 * END) & ~other)
        if len(long):
            n = size[long]
            wrong = raw[spread(start[long], n)] != self.book[spread(self.known_at[mine[long]], n)]
            other[long] = np.add.reduceat(wrong, np.cumsum(n) - n, dtype=np.int64) > 0
        return np.flatnonzero(other)

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts in a row, and their len+1 offsets."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= self.size or (self.lengths[ids] == 0).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.arange(total[-1]) + np.repeat(self.starts[ids] - total[:-1], size)]
        return raw, total[at]


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@cache
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder a process and vocabulary, from a file of this machine."""
    return Encoder(read(path))


_made: dict[str, Encoder] = {}


def shipped(documents: DataFrame, path: str) -> Callable[[], Encoder]:
    """The encoder for the workers: the driver reads the file (about a megabyte) and
    broadcasts it, so no other machine needs it.  A worker makes it once."""
    data = read(path)
    name = hashlib.sha256(data).hexdigest()
    shared = documents.sparkSession.sparkContext.broadcast(data)

    def get() -> Encoder:
        if name not in _made:
            _made[name] = Encoder(shared.value)
        return _made[name]

    return get


def id_lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encode(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns doc_id, ids: one row per row of documents."""
    made = shipped(documents, vocabulary)

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": id_lists(*made().encode(raw, at))}

    return over_text(documents, "doc_id long, ids array<int>", work)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns doc_id, text: the inverse of encode; null ids give a null text."""
    made = shipped(encoded, vocabulary)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            raw, cuts = made().decode(lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])
            text = pa.LargeStringArray.from_buffers(len(batch), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw.tobytes()))
            missing = lists.is_null()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.compute.if_else(missing, None, text).cast(pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_check(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns doc_id, ids, exact: the ids, and whether decoding gives the text back."""
    made = shipped(documents, vocabulary)

    def work(raw: np.ndarray, at: np.ndarray, batch: pa.RecordBatch) -> dict:
        ids, cuts = made().encode(raw, at)
        back, stops = made().decode(ids, cuts)
        exact = stops == at
        if not np.array_equal(back, raw):
            exact[:-1] &= [np.array_equal(back[a:b], raw[c:d]) for a, b, c, d in zip(stops[:-1], stops[1:], at[:-1], at[1:], strict=True)]
        return {"doc_id": batch.column("doc_id"), "ids": id_lists(ids, cuts), "exact": exact[1:] & exact[:-1]}

    return over_text(documents, "doc_id long, ids array<int>, exact boolean", work)
