"""Vectors of target words from sentences, by a pluggable encoder.

An encoder maps a batch of (tokens, target positions) to a matrix. A transformer can be plugged in where one is installed; here is a
deterministic one from hashes, for tests and as a baseline.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.stores import missing

MASK = "[MASK]"
Encoder = Callable[[list[list[str]], list[list[int]]], np.ndarray]


def masked_tokens(tokens: Column | str, index: Column | str, mask: str = MASK) -> Column:
    """The sentence with its first target token replaced by the mask; particles stay visible. Null where either is null."""
    tokens, index = (F.col(c) if isinstance(c, str) else c for c in (tokens, index))
    return F.transform(tokens, lambda t, i: F.when(i == F.get(index, F.lit(0)), F.lit(mask)).otherwise(t))


def _token_vector(token: str, dim: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(token.lower().encode(), digest_size=8).digest(), "big")
    return np.random.default_rng(seed).standard_normal(dim)


def hash_encoder(dim: int = 64, window: int = 3, pooling: str = "mean") -> Encoder:
    """A token's vector is drawn from its hash, plus those of its neighbours, less the farther they are. Targets are pooled by ``mean`` or ``first``."""
    if pooling not in ("mean", "first"):
        raise ValueError(f"pooling is mean or first, not {pooling!r}")

    def encode(sentences: list[list[str]], targets: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(sentences), dim))
        for k, (tokens, index) in enumerate(zip(sentences, targets)):
            at = [i for i in index if 0 <= i < len(tokens)]
            for i in at[:1] if pooling == "first" else at:
                for j in range(max(0, i - window), min(len(tokens), i + window + 1)):
                    out[k] += _token_vector(tokens[j] or "", dim) / (1 + abs(i - j))
            length = np.linalg.norm(out[k])
            out[k] = out[k] / length if length else out[k]
        return out

    return encode


def random_encoder(dim: int = 64, seed: int = 0) -> Encoder:
    """Unit vectors drawn from the sentence and the seed, for tests: the same sentence gets the same vector."""

    def encode(sentences, targets):
        x = np.stack([_token_vector(f"{seed}|{' '.join(map(str, s))}|{t}", dim) for s, t in zip(sentences, targets)]) if sentences else np.zeros((0, dim))
        return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x

    return encode


def extract(rows: DataFrame, encoder: Encoder, key: str = "id", tokens: str = "tokens", index: str = "lu_index", part: str | None = "lu_index_part", masked: bool = False) -> DataFrame:
    """``key, embedding`` of every row that has tokens and a target; ``masked`` hides the first target token. Batches go through the encoder as Arrow."""
    where = F.concat(F.col(index), F.coalesce(F.col(part), F.array().cast("array<int>"))) if part else F.col(index)
    words = masked_tokens(tokens, index) if masked else F.col(tokens)
    picked = rows.select(F.col(key).cast("long").alias("key"), words.alias("t"), where.alias("i")).where("key is not null and t is not null and size(i) > 0")

    def run(batches):
        for batch in batches:
            x = encoder(batch.column("t").to_pylist(), batch.column("i").to_pylist()).astype("f4")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] if x.ndim == 2 and x.shape[1] else 1), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "embedding"])

    return picked.mapInArrow(run, "key long, embedding array<float>")


def extract_missing(rows: DataFrame, store: DataFrame, encoder: Encoder, key: str = "id", **options) -> DataFrame:
    """Vectors of the rows that the store lacks, to be appended to it."""
    todo = missing(rows.withColumn("_key", F.col(key).cast("long")), store.select(F.col("key").alias("_key")), "_key").drop("_key")
    return extract(todo, encoder, key, **options)
