"""Embedders: the offline one in plain expressions, models behind Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .limits import reserve

Vectors = Sequence[Sequence[float]]


@dataclass(frozen=True)
class Embedder:
    """``load`` is called once per task and gives a function from texts to vectors; None: offline."""

    name: str
    load: Callable[[], Callable[[list[str]], Vectors]] | None = None
    dim: int = 64
    is_local: bool = False


OFFLINE = Embedder("offline-hash", None, 64, True)


def offline_vector(text: Column, dim: int = 64) -> Column:
    """Counts of hashed lower-case tokens with hashed signs, scaled to length one; zeros without tokens.

    Tokens are cut and hashed in the JVM; one Arrow batch of hashes at a time becomes vectors.
    """
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")

    @F.pandas_udf("array<float>")
    def summed(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate([np.asarray(h, np.int64) for h in hashes]) if len(hashes) else np.zeros(0, np.int64)
        cell = np.repeat(np.arange(len(sizes)), sizes) * dim + flat % dim
        sums = np.bincount(cell, np.where((flat >> 32) & 1, 1.0, -1.0), len(sizes) * dim).reshape(-1, dim)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        return pd.Series(list((sums / np.where(norm > 0, norm, 1)).astype(np.float32)))

    return summed(F.transform(tokens, lambda t: F.xxhash64(t)))


def as_floats(vectors: Any) -> list[list[float]]:
    """Vectors of any array kind, those on an accelerator included, as plain float32 lists."""
    if hasattr(vectors, "detach"):
        vectors = vectors.detach().cpu().numpy()
    out = [np.asarray(v.detach().cpu().numpy() if hasattr(v, "detach") else v, np.float32).tolist() for v in vectors]
    return out


def embedded(df: DataFrame, embedder: Embedder, text: str, out: str = "embedding", rate_limit: int | None = None) -> DataFrame:
    """``df`` with the vectors of its texts; equal texts should be deduplicated before.

    With a rate limit (texts a minute over the whole job) each task gets an equal share.
    """
    if embedder.load is None:
        return df.withColumn(out, offline_vector(F.col(text), embedder.dim))
    load, share = embedder.load, None
    if rate_limit:
        share = rate_limit / max(1, df.rdd.getNumPartitions())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, free_at = load(), 0.0
        for batch in batches:
            if share:
                wait, free_at = reserve(len(batch), share, free_at, time.monotonic())
                time.sleep(wait)
            vectors = as_floats(encode(batch[text].tolist()))
            if len(vectors) != len(batch):
                raise ValueError("the model gave no vector for some texts")
            yield batch.assign(**{out: vectors})

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])
    return df.mapInPandas(run, schema)


def sentence_model(model: str, prompt_name: str | None = None, batch_size: int = 32) -> Callable[[], Callable[[list[str]], Vectors]]:
    """A local sentence-embedding model; the package is needed where the tasks run."""

    def load() -> Callable[[list[str]], Vectors]:
        from sentence_transformers import SentenceTransformer

        encoder = SentenceTransformer(model)
        return lambda texts: encoder.encode(texts, prompt_name=prompt_name, batch_size=batch_size)

    return load


def hosted_google(model: str) -> Callable[[], Callable[[list[str]], Vectors]]:
    def load() -> Callable[[list[str]], Vectors]:
        from google import genai

        client = genai.Client()

        def encode(texts: list[str]) -> Vectors:
            found = client.models.embed_content(model=model, contents=texts).embeddings
            if not found or any(e.values is None for e in found):
                raise ValueError("the service gave no embeddings")
            return [e.values for e in found]

        return encode

    return load


def hosted_openai(model: str) -> Callable[[], Callable[[list[str]], Vectors]]:
    def load() -> Callable[[list[str]], Vectors]:
        from openai import OpenAI

        client = OpenAI()
        return lambda texts: [d.embedding for d in client.embeddings.create(model=model, input=texts).data]

    return load
