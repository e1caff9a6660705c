"""Embedders: batches of texts to vectors. The default needs no model and no network."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


class Embedder(Protocol):
    """What a model must offer; it is made once in each worker."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedProjection:
    """Words hashed to signed places and scaled to length 1; the same text gives the same vector everywhere. A text without words gives zeros."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import re

        import xxhash

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = xxhash.xxh64_intdigest(word)
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embedding(text: Column, make=HashedProjection) -> Column:
    """The vector of each text by the embedder that `make` returns; missing for a missing text."""

    @pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            vectors = model.embed([t or "" for t in s])
            yield pd.Series([None if t is None else v for t, v in zip(s, vectors)])

    return run(text)
