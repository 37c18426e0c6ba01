"""Embedding providers: an HTTP endpoint, a local model, or hashed words.

A provider maps texts to vectors, several at once; ``over`` applies one to a
DataFrame in sub-batches, and a sub-batch that fails is recorded row by row."""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame

BATCH = 64


@dataclass(frozen=True)
class Api:
    url: str = "http://localhost:8080/v1/embeddings"
    model: str = "Qwen3-Embedding-0.6B-Q8_0"
    key: str = ""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"model": self.model, "input": texts, "encoding_format": "float"}).encode()
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, body, headers)  # noqa: S310
        try:
            with urllib.request.urlopen(request, timeout=30 if len(texts) == 1 else 60) as response:  # noqa: S310
                status, answer = response.status, response.read()
        except urllib.error.HTTPError as error:
            status, answer = error.code, error.read()
        try:
            got = json.loads(answer)
        except ValueError as error:
            raise RuntimeError(f"no JSON in the answer (status {status})") from error
        if status != 200:
            raise RuntimeError(f"status {status}: {(got.get('error') or {}).get('message') or 'no message'}")
        data = sorted(got.get("data") or [], key=lambda d: d.get("index", 0))
        if len(data) != len(texts):
            raise RuntimeError(f"{len(data)} embeddings for {len(texts)} texts")
        return [d["embedding"] for d in data]


@dataclass(frozen=True)
class Local:
    """A GGUF model, loaded once in each process that uses it."""

    path: str
    cache: bool = False

    def __call__(self, texts: list[str]) -> list[list[float]]:
        model = _models.get((self.path, self.cache))
        if model is None:
            from .model import Model

            # in a task on another machine the file came with the job
            here = os.path.exists(self.path) or TaskContext.get() is None
            path = self.path if here else SparkFiles.get(os.path.basename(self.path))
            model = _models[self.path, self.cache] = Model(path, self.cache)
        return [model.embed(t).tolist() for t in texts]


_models: dict = {}


@dataclass(frozen=True)
class Hashed:
    """Signed word hashes, normalised: for tests and for use without a model."""

    size: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.size)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).tolist())
        return out


Provider = Callable[[list[str]], list[list[float]]]


def provider(api: bool = False, url: str = Api.url, model: str = Api.model, key: str = "", path: str | None = None, cache: bool = False) -> Provider | None:
    """The provider of the settings after a try; None (AI is off) if it fails."""
    made: Provider | None = Api(url, model, key) if api else Local(path, cache) if path else None
    try:
        if made is None or not made(["test"])[0]:
            return None
    except (OSError, RuntimeError, ValueError, KeyError):
        return None
    return made


def over(rows: DataFrame, embed: Provider, batch: int = BATCH) -> DataFrame:
    """id, embedding, error of rows (id, input)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                try:
                    vectors, error = embed(part["input"].tolist()), None
                except Exception as failure:  # noqa: BLE001 - any failure costs this sub-batch only
                    vectors, error = [None] * len(part), str(failure) or type(failure).__name__
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": vectors, "error": [error] * len(part)})

    return rows.select("id", "input").mapInPandas(run, "id long, embedding array<float>, error string")
