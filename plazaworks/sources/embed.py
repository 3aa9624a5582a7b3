"""Text to vectors: a pluggable embedder over partitions, and a stand-in that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prefixes that tell a query from a passage.
PREFIX = {"query": "query: ", "passage": "passage: "}


class Embedder(Protocol):
    """model: a name kept beside each vector; dim: vectors' length. Called in tasks with a batch of texts."""

    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def vectors_in_order(items: list[tuple[int, list[float]]], expected: int, dim: int) -> list[list[float]]:
    """The vectors of a service's answer, (index, vector) in any order, by their index; another number, index or length is an error."""
    ordered = sorted(items, key=lambda item: item[0])
    if [index for index, _ in ordered] != list(range(expected)):
        raise ValueError(f"embeddings of {[index for index, _ in ordered]} for {expected} texts")
    for _, vector in ordered:
        if len(vector) != dim:
            raise ValueError(f"an embedding has {len(vector)} numbers, not {dim}")
    return [vector for _, vector in ordered]


class HashEmbedder:
    """Unit vectors from hashes of words: alike texts are near, the same text is the same vector."""

    model = "hash-1"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _word(self, word: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return np.random.default_rng(seed).normal(size=self.dim)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            total = sum((self._word(w) for w in text.lower().split()), np.zeros(self.dim))
            norm = np.linalg.norm(total)
            out.append((total / norm if norm else total).tolist())
        return out


def with_vectors(df: DataFrame, embedder: Embedder, text: str = "body", kind: str = "passage", batch: int = 64) -> DataFrame:
    """df with columns embedding and embedding_model; a blank or null text has a model but no vector.

    Texts of a batch that the embedder fails on, or answers with vectors of
    another number or length, have neither: they stay stale and are tried again.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").str.strip()
            vectors: list[list[float] | None] = [None] * len(frame)
            models: list[str | None] = [embedder.model] * len(frame)
            filled = [i for i, t in enumerate(texts) if t]
            for k in range(0, len(filled), batch):
                part = filled[k : k + batch]
                try:
                    found = embedder.embed([PREFIX[kind] + texts.iloc[i] for i in part])
                except Exception:  # noqa: BLE001 - whatever a service fails with concerns its texts only
                    found = []
                sound = len(found) == len(part) and all(len(v) == embedder.dim for v in found)
                for i, v in zip(part, found if sound else [None] * len(part), strict=True):
                    vectors[i], models[i] = v, embedder.model if sound else None
            yield frame.assign(embedding=vectors, embedding_model=models)

    bare = df.drop("embedding", "embedding_model")
    schema = bare.select("*", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model")).schema
    return bare.mapInPandas(work, schema)
