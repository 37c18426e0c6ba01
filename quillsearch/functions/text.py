"""Text functions: tokens, query phrases, previews, scores, compression."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import MARKS, SOURCE, TARGET

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
#: Unicode white space; the regular expressions' own class is ASCII only.
BLANK = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_FOLD = str.maketrans(SOURCE, TARGET, MARKS)


def fold(text: Column) -> Column:
    """Accents and case folded; folding comes first, or a dotted capital I would grow."""
    plain = F.char_length(text) == F.octet_length(text)  # translating goes sign by sign: only where it can matter
    return F.lower(F.when(plain, text).otherwise(F.translate(text, SOURCE + MARKS, TARGET)))


def tokens(text: Column) -> Column:
    """The array of tokens; an empty one for null."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _token_char(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co"


def spans(text: str) -> list[tuple[str, int, int]]:
    """Tokens of a text with their starts and ends in it (driver side, few rows)."""
    out, start = [], None
    for i, c in enumerate(text + " "):
        inside = _token_char(c) or (start is not None and c in MARKS)
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            word = text[start:i].translate(_FOLD).lower()
            if word:
                out.append((word, start, i))
            start = None
    return out


def phrases(query: str) -> list[list[str]]:
    """A query's phrases: each blank-separated word is a phrase of its tokens.

    Words without tokens are left out; repeats stay."""
    return [p for w in query.split() if (p := [t for t, _, _ in spans(w)])]


def quoted(query: str) -> str:
    """The query as quoted phrases, as a full-text MATCH string."""
    return " ".join('"' + w.replace('"', '""') + '"' for w in query.split())


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")


def fields(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def preview(text: Column) -> Column:
    """The first 160 characters, with dots if there are more."""
    return F.when(F.char_length(text) > 160, F.concat(F.substring(text, 1, 160), F.lit("..."))).otherwise(text)


def power(bm25: Column) -> Column:
    """BM25 (smaller is better) as a score from 0 to 100."""
    return (1 - F.exp(-0.1 * F.greatest(-bm25, F.lit(0.0)))) * 100


def first_number(text: Column) -> Column:
    """The first integer in a text; 0 if there is none or it is too large."""
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+", 0).try_cast("long"), F.lit(0))


#: Characters or bytes that a function in Python has in hand at once, besides its batch.
SLICE = 1 << 20


def sliced(batches: Iterator[pa.Array], one: Callable, kind: pa.DataType, most: int = SLICE, times: int = 1) -> Iterator[pa.Array]:
    """one(value) of each value, in small arrays: batches are cut where their values, ``times``
    their size, come to ``most``, so memory follows neither rows nor what is made of them."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64) * times + 64)
        at, done = 0, 0
        # an empty batch is answered too
        while at < len(batch) or at == 0:
            end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
            yield pa.array([one(v.as_py()) for v in batch.slice(at, end - at)], kind)
            at, done = end, int(sizes[end - 1]) if len(batch) else 0


@F.arrow_udf(T.BinaryType())
def deflate(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Raw deflate at the best level; empty stays empty, null null."""

    def one(value: str | None) -> bytes | None:
        if value is None:
            return None
        if not value:
            return b""
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        return z.compress(value.encode()) + z.flush()

    return sliced(texts, one, pa.binary())


@F.arrow_udf(T.StringType())
def inflate(data: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # deflated texts are some three times smaller than the texts, repeated ones more
    return sliced(data, lambda v: None if v is None else zlib.decompress(v, -15).decode() if v else "", pa.string(), times=4)


def snippet(text: str | None, query: Sequence[Sequence[str]], n: int, before: str = "<mark>", after: str = "</mark>") -> str | None:
    """The window of n tokens that shows the query's phrases best, with marks."""
    if text is None:
        return None
    found = spans(text)
    words = [w for w, _, _ in found]
    total = len(words)
    hits = sorted({(k, i, len(p)) for i, p in enumerate(map(list, query)) for k in range(total - len(p) + 1) if words[k : k + len(p)] == p})
    heads = [k for k in range(total) if k == 0 or re.search(r"[.:][ \t\r\n]$", text[: found[k][1]][-2:])]

    def value(at: int) -> tuple[int, int, int]:
        seen, score, first, last = set(), 0, -1, at
        for k, phrase, size in hits:
            if at <= k < at + n:
                score += 1 if phrase in seen else 1000
                seen.add(phrase)
                first = k if first < 0 else first
                last = k + size
        return score, first, last

    best, start = 0, 0
    for k, _, _ in hits:
        score, first, last = value(k)
        if score > best:
            best, start = score, max(0, min(first - int((n - (last - first)) / 2), total - n))
        if total > n and (head := max((h for h in heads if h <= k), default=k)) < k:
            score = value(head)[0] + (120 if head == 0 else 100)
            if score > best:
                best, start = score, head
    if not found:
        return text
    out = ["..."] if start > 0 else []
    at = found[start][1] if start > 0 else 0
    stop = min(start + n, total)
    marks: list[list[int]] = []
    for k, _, size in hits:
        if k + size > start and k < stop:
            a, b = max(k, start), min(k + size, stop)
            if marks and a < marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], b)
            else:
                marks.append([a, b])
    for a, b in marks:
        out += [text[at : found[a][1]], before, text[found[a][1] : found[b - 1][2]], after]
        at = found[b - 1][2]
    out.append(text[at:] if stop == total else text[at : found[stop - 1][2]] + "...")
    return "".join(out)


def snippets(text: Column, query: Sequence[Sequence[str]], n: int) -> Column:
    """Snippets as a column: for the few rows of a result only."""
    wanted = [list(p) for p in query]

    @F.pandas_udf(T.StringType())
    def show(values: pd.Series) -> pd.Series:
        return values.map(lambda v: snippet(v, wanted, n))

    return show(text)
