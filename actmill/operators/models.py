"""Interfaces of pluggable models, and deterministic stand-ins that need no weights."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from actmill.functions.text import tokenize

#: A factory of encoders: built once for each task, then called with batches of texts.
Encoder = Callable[[], Callable[[list[str]], list]]
#: A scorer of (question, text) pairs, as a column.
PairScorer = Callable[[Column, Column], Column]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Unit vectors of signed word counts, hashed to dim places."""

    def build() -> Callable[[list[str]], list]:
        def encode(texts: list[str]) -> list:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1.0 if h >> 31 else -1.0
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return list(np.divide(out, norm, out=out, where=norm > 0).astype(np.float32))

        return encode

    return build


def overlap_scorer(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has, rounded to 6 places; a lexical stand-in for a cross-encoder."""
    q, t = F.array_distinct(tokenize(question)), tokenize(text)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6)).otherwise(F.lit(0.0))
