"""A decoder-only embedding model in numpy, read from a GGUF file."""

from __future__ import annotations

import numpy as np

from .bpe import END, Tokenizer
from .gguf import Q8, Gguf

DEFAULTS = {
    "block_count": 28, "embedding_length": 1024, "attention.head_count": 16, "attention.head_count_kv": 8, "attention.head_dim": 128,
    "feed_forward_length": 3072, "rope.freq_base": 1e6, "attention.layer_norm_rms_epsilon": 1e-6,
}


def rms(x: np.ndarray, weight: np.ndarray, eps: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * weight


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """``cache`` keeps the weights in memory; else they are read when needed."""

    def __init__(self, path: str, cache: bool = False):
        self.file = Gguf(path)
        meta = self.file.metadata
        self.arch = meta.get("general.architecture")
        if self.arch not in ("qwen2", "qwen3"):
            raise ValueError("only the qwen2 and qwen3 architectures run locally")
        if "blk.0.attn_q.weight" not in self.file.tensors or self.file.kind("blk.0.attn_q.weight") != Q8:
            raise ValueError("only Q8.0 weights run locally")
        for key, value in DEFAULTS.items():
            setattr(self, key.split(".")[-1], meta.get(f"{self.arch}.{key}", value))
        self.head_dim = self.head_dim or self.embedding_length // self.head_count
        if "tokenizer.ggml.tokens" not in meta:
            raise ValueError("the file has no tokens")
        self.tokenizer = Tokenizer(meta["tokenizer.ggml.tokens"], meta.get("tokenizer.ggml.merges", []), meta.get("tokenizer.ggml.eos_token_id", END))
        self.kept: dict[str, np.ndarray] | None = {} if cache else None

    def weight(self, name: str) -> np.ndarray:
        if self.kept is None:
            return self.file.tensor(name)
        if name not in self.kept:
            self.kept[name] = self.file.tensor(name)
        return self.kept[name]

    def heads(self, x: np.ndarray, layer: str, part: str, count: int) -> np.ndarray:
        y = x @ self.weight(f"{layer}.attn_{part}.weight").T
        if f"{layer}.attn_{part}.bias" in self.file.tensors:
            y = y + self.weight(f"{layer}.attn_{part}.bias")
        y = y.reshape(len(x), count, self.head_dim)
        norm = f"{layer}.attn_{part}_norm.weight"
        return rms(y, self.weight(norm), self.layer_norm_rms_epsilon) if norm in self.file.tensors else y

    def rotate(self, x: np.ndarray) -> np.ndarray:
        half = self.head_dim // 2
        angle = np.arange(len(x))[:, None] / np.power(self.freq_base, 2 * np.arange(half) / self.head_dim)
        cos, sin = np.cos(angle)[:, None, :], np.sin(angle)[:, None, :]
        a, b = x[..., :half], x[..., half:]
        return np.concatenate([a * cos - b * sin, b * cos + a * sin], axis=-1)

    def attend(self, x: np.ndarray, layer: str) -> np.ndarray:
        n = len(x)
        q = self.rotate(self.heads(x, layer, "q", self.head_count))
        k = self.rotate(self.heads(x, layer, "k", self.head_count_kv))
        v = self.heads(x, layer, "v", self.head_count_kv)
        group = self.head_count // self.head_count_kv
        k, v = np.repeat(k, group, axis=1), np.repeat(v, group, axis=1)
        scores = np.einsum("ihd,jhd->hij", q, k) / np.sqrt(self.head_dim)
        scores = np.where(np.tril(np.ones((n, n), dtype=bool)), scores, -np.inf)
        mixed = np.einsum("hij,jhd->ihd", softmax(scores), v).reshape(n, -1)
        return mixed @ self.weight(f"{layer}.attn_output.weight").T

    def feed(self, x: np.ndarray, layer: str) -> np.ndarray:
        gate, up = x @ self.weight(f"{layer}.ffn_gate.weight").T, x @ self.weight(f"{layer}.ffn_up.weight").T
        return (gate / (1 + np.exp(-gate)) * up) @ self.weight(f"{layer}.ffn_down.weight").T

    def embed_ids(self, ids: list[int]) -> np.ndarray:
        x = np.stack([self.file.row("token_embd.weight", i) for i in ids]).astype(np.float32)
        eps = self.layer_norm_rms_epsilon
        for i in range(self.block_count):
            layer = f"blk.{i}"
            x = x + self.attend(rms(x, self.weight(f"{layer}.attn_norm.weight"), eps), layer)
            x = x + self.feed(rms(x, self.weight(f"{layer}.ffn_norm.weight"), eps), layer)
        last = rms(x[-1], self.weight("output_norm.weight"), eps)
        size = np.sqrt((last * last).sum())
        return last / size if size > 0 else last

    def embed(self, text: str) -> np.ndarray:
        return self.embed_ids(self.tokenizer.encode(text))
