"""Reader of GGUF version 3 model files, memory-mapped."""

from __future__ import annotations

import struct
from typing import Any

import numpy as np

_PLAIN = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
STRING, ARRAY = 8, 9
F32, F16, Q8, BF16 = 0, 1, 8, 30


class Gguf:
    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        self.at = 0
        if bytes(self.data[:4]) != b"GGUF":
            raise ValueError("not a GGUF file")
        self.at = 4
        if (version := self._plain("<I")) != 3:
            raise ValueError(f"unsupported GGUF version {version}")
        tensors, pairs = self._plain("<Q"), self._plain("<Q")
        self.metadata: dict[str, Any] = {}
        for _ in range(pairs):
            key = self._string()
            self.metadata[key] = self._value(self._plain("<I"))
        self.tensors: dict[str, tuple[tuple[int, ...], int, int]] = {}
        for _ in range(tensors):
            name = self._string()
            shape = tuple(self._plain("<Q") for _ in range(self._plain("<I")))
            self.tensors[name] = (shape, self._plain("<I"), self._plain("<Q"))
        align = int(self.metadata.get("general.alignment", 32))
        self.start = -(-self.at // align) * align

    def _plain(self, kind: str):
        size = struct.calcsize(kind)
        (value,) = struct.unpack(kind, self.data[self.at : self.at + size].tobytes())
        self.at += size
        return value

    def _string(self) -> str:
        size = self._plain("<Q")
        value = self.data[self.at : self.at + size].tobytes().decode("utf-8", "replace")
        self.at += size
        return value

    def _value(self, kind: int):
        if kind in _PLAIN:
            return self._plain(_PLAIN[kind])
        if kind == STRING:
            return self._string()
        if kind == ARRAY:
            inner, size = self._plain("<I"), self._plain("<Q")
            return [self._value(inner) for _ in range(size)]
        raise ValueError(f"unknown GGUF value type {kind}")

    def kind(self, name: str) -> int:
        return self.tensors[name][1]

    def tensor(self, name: str) -> np.ndarray:
        """A tensor in float32, rows first (files have the fastest dimension first)."""
        if name not in self.tensors:
            raise KeyError(name)
        shape, kind, offset = self.tensors[name]
        return self._read(kind, self.start + offset, int(np.prod(shape, dtype=np.int64))).reshape(shape[::-1])

    def row(self, name: str, number: int) -> np.ndarray:
        """One row of a matrix, without reading the others."""
        shape, kind, offset = self.tensors[name]
        if not 0 <= number < shape[1]:
            raise IndexError(f"row {number} of {name}")
        width = {F32: 4 * shape[0], F16: 2 * shape[0], BF16: 2 * shape[0], Q8: shape[0] // 32 * 34}[kind]
        return self._read(kind, self.start + offset + number * width, shape[0])

    def _read(self, kind: int, at: int, size: int) -> np.ndarray:
        def raw(n: int) -> bytes:
            return self.data[at : at + n].tobytes()

        if kind == F32:
            return np.frombuffer(raw(4 * size), "<f4")
        if kind == F16:
            return np.frombuffer(raw(2 * size), "<f2").astype(np.float32)
        if kind == BF16:
            return (np.frombuffer(raw(2 * size), "<u2").astype(np.uint32) << 16).view(np.float32)
        if kind == Q8:
            blocks = -(-size // 32)
            b = np.frombuffer(raw(34 * blocks), np.dtype([("d", "<f2"), ("q", "i1", 32)]))
            return (b["q"].astype(np.float32) * b["d"].astype(np.float32)[:, None]).ravel()[:size]
        raise ValueError(f"unsupported tensor type {kind}")
