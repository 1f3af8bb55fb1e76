"""Injected models with offline stand-ins: embeddings and reranking."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Answers worth another try, and the wait before it.
RETRIED, FIRST_WAIT, LONGEST_WAIT, MOST_TRIES = (429, 502, 503, 504), 0.1, 2.0, 4


class ProviderError(RuntimeError):
    def __init__(self, status: int, message: str = ""):
        super().__init__(message or f"provider answered {status}")
        self.status = status


def hashed_vector(text: str, dimension: int) -> list[float]:
    """Offline stand-in: words hashed to signed places, unit length."""
    v = np.zeros(dimension)
    for w in text.lower().split() or [text]:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        v[h % dimension] += 1 if h >> 63 else -1
    n = math.sqrt(float(v @ v))
    if n == 0:
        v[0], n = 1.0, 1.0
    return (v / n).tolist()


def embed_batch(provider: Callable[[list[str]], Sequence[Sequence[float]]], texts: list[str], sleep=time.sleep) -> list[list[float]]:
    """Vectors in order; too large a request is halved, a busy provider is asked again, vectors are checked."""
    for attempt in range(MOST_TRIES):
        try:
            vectors = [list(map(float, v)) for v in provider(texts)]
            break
        except ProviderError as e:
            if e.status == 413 and len(texts) > 1:
                half = len(texts) // 2
                return embed_batch(provider, texts[:half], sleep) + embed_batch(provider, texts[half:], sleep)
            if e.status not in RETRIED or attempt + 1 == MOST_TRIES:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
    if len(vectors) != len(texts) or len({len(v) for v in vectors}) > 1 or any(not math.isfinite(x) for v in vectors for x in v):
        raise ValueError("the provider's vectors don't fit the request")
    return vectors


def embed(rows: DataFrame, text_col: str, dimension: int, provider: Callable | None = None, batch: int = 64) -> DataFrame:
    """rows plus embedding (array<float>), one provider call a batch."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            call = provider or (lambda xs: [hashed_vector(x, dimension) for x in xs])
            listed = texts.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(listed), batch) for v in embed_batch(call, listed[k : k + batch])], dtype=object)

    return rows.withColumn("embedding", vectors(F.col(text_col)))


def query_vector(provider, text: str) -> list[float]:
    """A bare vector, a batch of one, or an object with vectors."""
    value = provider(text) if callable(provider) else provider.embed(text)
    value = getattr(value, "vectors", value)
    return list(value[0] if value and isinstance(value[0], Sequence) else value)


def rerank_scores(reranker: Callable[[str, list[str]], Sequence[float]], query: str, candidates: DataFrame) -> DataFrame | None:
    """Id, score of every candidate; None when the provider fails or answers another number. Candidates are a bounded top-k."""
    rows = candidates.orderBy("before_rank").select("id", "content").collect()
    try:
        scores = list(reranker(query, [r["content"] for r in rows]))
    except (RuntimeError, TypeError, ValueError, OSError):
        return None
    if len(scores) != len(rows):
        return None
    return candidates.sparkSession.createDataFrame([(r["id"], float(s)) for r, s in zip(rows, scores, strict=True)], candidates.select("id").schema.add("score", "double"))


def vector_backend(name: str):
    """One exact backend; other names are errors."""
    if name != "exact":
        raise ValueError(f"vector provider {name!r} is not supported")
    from . import retrieval

    return retrieval.vector_hits
