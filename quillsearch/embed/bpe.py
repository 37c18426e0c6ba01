"""Byte-level BPE as embedding models use it: no pre-tokenisation."""

from __future__ import annotations

import heapq
import re

END = 151643


def byte_characters() -> list[str]:
    """A printable character for each byte; the unprintable ones follow from 256 on."""
    own = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in own else chr(extra))
        extra += b not in own
    return out


class Tokenizer:
    def __init__(self, tokens: list[str], merges: list[str], end: int = END):
        self.ids = {t: i for i, t in enumerate(tokens)}
        pairs = (m.split(" ", 1) for m in merges)
        self.ranks = {tuple(p): i for i, p in enumerate(pairs) if len(p) == 2}
        self.end = end
        self.characters = byte_characters()
        special = sorted((t for t in self.ids if self.special(t)), key=lambda t: (-len(t), t))
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    @staticmethod
    def special(token: str) -> bool:
        return len(token) > 4 and token.startswith("<|") and token.endswith("|>")

    def merge(self, text: str) -> list[str]:
        """Lowest rank first, leftmost of equals, with a heap of pairs."""
        parts: list[str | None] = [self.characters[b] for b in text.encode()]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(parts) and (r := self.ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p in parts if p is not None]

    def encode(self, text: str) -> list[int]:
        """Ids, unknown symbols left out, and the end id."""
        out = []
        for piece in self.cut.split(text) if self.cut else [text]:
            symbols = [piece] if piece in self.ids and self.special(piece) else self.merge(piece)
            out += [self.ids[s] for s in symbols if s in self.ids]
        return [*out, self.end]
