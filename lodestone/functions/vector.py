"""Vectors: embedders, and what single pairs and groups of similarities need; see `similarity` for searches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import model_prefix


class Embedder(Protocol):
    """Turns texts into vectors inside Python workers; `fingerprint` names model and settings. An embedder with a
    `family` (see `config`) gets its texts with the prefixes of that family."""

    fingerprint: str
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class BigramEmbedder:
    """Hashed character bigrams, unit length: deterministic, lexical, needs no model."""

    def __init__(self, dim: int = 64):
        self.dim, self.fingerprint = dim, f"bigram:{dim}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            t = f" {(text or '').lower().strip()} "
            for a, b in zip(t, t[1:], strict=False):
                row[(ord(a) * 31 + ord(b)) % self.dim] += 1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, text: str, embedder: Embedder, column: str = "embedding", kind: str = "passage") -> DataFrame:
    """df with the vectors of a text column; one Arrow batch at a time, the model once a worker. kind: `query` for what is
    asked, `passage` for what is kept."""
    prefix = model_prefix(getattr(embedder, "family", None), kind)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embedder([prefix + t for t in texts.fillna("")]).astype(np.float32)))

    return df.withColumn(column, run(F.col(text)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, in double; 0 if either has no length. For single pairs, not scans."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def check_dimension(vector: Column, dim: int) -> Column:
    return F.when(vector.isNull() | (F.size(vector) == dim), vector).otherwise(F.raise_error(F.format_string("vector of %d dimensions where %d are stored", F.size(vector), F.lit(dim))))


def unit(rows: list | np.ndarray) -> np.ndarray:
    """Rows of length one, in double; rows without length stay zero."""
    m = np.asarray(rows, np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def max_sim(sims: DataFrame, by: list[str]) -> DataFrame:
    """The best similarity of each group, say of a memory's whole vector and its sentences."""
    return sims.groupBy(*by).agg(F.max("sim").alias("sim"))
