"""Embedding writes and the pipeline that fills what is pending."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from conceptlake.errors import InvalidParameter

KEY = ["bundle_id", "concept_id"]


def check(new: DataFrame, dim: int) -> DataFrame:
    """``new`` if all vectors are finite and of ``dim`` numbers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (F.size("embedding") != dim)
    if not new.where(F.coalesce(bad, F.lit(True))).isEmpty():
        raise InvalidParameter(f"embeddings must be finite and of {dim} numbers")
    return new


def store(embeddings: DataFrame, new: DataFrame, concepts: DataFrame) -> DataFrame:
    """Embeddings after a compare-and-set write: a vector is taken only if its source_file_hash is the concept's now."""
    live = concepts.select(*KEY, F.col("file_hash").alias("source_file_hash"))
    good = new.join(live, [*KEY, "source_file_hash"], "left_semi")
    return embeddings.join(good.select(*KEY), KEY, "left_anti").unionByName(good)


def drop_changed(embeddings: DataFrame, diff: DataFrame) -> DataFrame:
    """Embeddings without those of concepts that a sync has changed or removed."""
    return embeddings.join(diff.where("change IN ('updated', 'removed')").select(*KEY), KEY, "left_anti")


def hashed_words(text: str, dim: int) -> list[float]:
    """A stand-in for a model: signed counts of hashed words, of unit length."""
    v = [0.0] * dim
    for word in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def embed(inputs: DataFrame, dim: int, embedder: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 64) -> DataFrame:
    """``inputs`` (bundle_id, concept_id, input) to (…, embedding, dim), in batches; ``embedder`` may call a service."""
    work = embedder or (lambda texts: [hashed_words(t, dim) for t in texts])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                vectors = work(part["input"].fillna("").tolist())
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise InvalidParameter("the embedder gave other vectors than asked for")
                yield pd.DataFrame({"bundle_id": part["bundle_id"], "concept_id": part["concept_id"], "embedding": vectors, "dim": dim})

    return inputs.select(*KEY, "input").mapInPandas(run, "bundle_id long, concept_id string, embedding array<float>, dim int")
