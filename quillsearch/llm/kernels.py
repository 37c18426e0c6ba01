"""Vectorised text kernels shared by the corpus operators.

Everything here works on whole Arrow batches with numpy: no Python loop per
word.  A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes;
ASCII letters are folded to lower case.  A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about this many bytes to bound memory.
SLICE_BYTES = 1 << 21
SLICE_ROWS = 2048

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_RAW = np.arange(256, dtype=np.uint64)
_POWERS = np.empty(4096, dtype=np.uint64)
_p = 1
for _i in range(4096):
    _POWERS[_i] = _p
    _p = (_p * 0x9E3779B97F4A7C15 + 2 * _i) % (1 << 64) | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); returns a new array."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_large(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and its len+1 offsets into them."""
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(sizes: np.ndarray, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``most`` bytes, at least a row each."""
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and (total + size > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def runs(raw: np.ndarray, at: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes that stay inside one text.

    Returns the runs' starts and ends and, per text, the index of its first
    run (len+1 entries)."""
    inside = member[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at] = True
    cuts = np.flatnonzero(edge)
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return starts, ends, np.searchsorted(starts, at)


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = _FOLD) -> np.ndarray:
    """A 64-bit hash of each byte run, independent of where it stands."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = int(size.sum())
    first = np.cumsum(size) - size
    place = np.arange(total, dtype=np.int64)
    within = place - np.repeat(first, size)
    byte = raw[np.repeat(starts, size) + within]
    value = (fold[byte] + np.uint64(1)) * _POWERS[within & 4095]
    if int(size.max()) > 4096:
        # each block of a long run has a factor of its own, so blocks can't change places
        value *= mix(within >> 12) | np.uint64(1)
    return mix(np.add.reduceat(value, first) ^ size.astype(np.uint64))


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per text the index of its first word."""
    starts, ends, first = runs(raw, at, _WORD)
    return run_hashes(raw, starts, ends), first


def owners(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, owner: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at offsets 0, gaps[0], gaps[0]+gaps[1], … of each
    position, dropped where they would leave the text; with their owners."""
    reach = sum(gaps)
    n = len(hashes) - reach
    if n <= 0:
        return hashes[:0], owner[:0]
    whole = owner[:n] == owner[reach:]
    out, step = hashes[:n], 0
    for k, gap in enumerate(gaps):
        step += gap
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[step : step + n] + np.uint64(k + 31 * gap))
    return out[whole], owner[:n][whole]
