"""Model ports: what a chat, embedding or rerank service must offer, deterministic stand-ins, and retries."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

T = TypeVar("T")


class ModelPort(Protocol):
    def chat(self, system: str, user: str) -> str: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class HashedModel:
    """A stand-in without a network: embeddings are signed hashes of the words, scores their overlap."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def chat(self, system: str, user: str) -> str:
        return "{}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h >> 16 & 1 else -1
        return (out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))).tolist()

    def rerank(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(t.lower().split())) / max(1, len(q)) for t in texts]


def with_retry(call: Callable[[], T], attempts: int = 2, wait_ms: int = 200, retryable: Callable[[Exception], bool] = lambda e: True) -> T:
    """Up to so many attempts, wait_ms * n between them; an error that is not retryable is raised at once."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if n == attempts or not retryable(e):
                raise
            time.sleep(wait_ms * n / 1000)
    raise AssertionError


def embedding(text: Column, port: ModelPort) -> Column:
    """The port's vectors, a batch of rows at a time."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(port.embed(texts.fillna("").tolist()), index=texts.index)

    return run(text)
