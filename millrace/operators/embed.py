"""Embedding text in batches, with a lookup of what is embedded already."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cache_key, right_dimension
from ..tables import materialize


def hash_vector(text: str, dimension: int) -> np.ndarray:
    """A unit vector from a text's hash: the same for the same text, for tests and for runs without a model."""
    stream, seed = b"", hashlib.sha256(text.encode()).digest()
    while len(stream) < 4 * dimension:
        stream += seed
        seed = hashlib.sha256(seed).digest()
    v = np.frombuffer(stream[: 4 * dimension], dtype="<u4").astype(np.float64) / 2**31 - 1
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def hash_batch(texts: list[str], dimension: int) -> list[np.ndarray]:
    """An embedder by hashes."""
    return [hash_vector(t, dimension) for t in texts]


def embed(rows: DataFrame, embedder: Callable[[list[str]], list], *, text_col: str = "text", dimension: int, batch: int = 96) -> DataFrame:
    """Add ``embedding``: ``embedder`` gets at most ``batch`` texts at once and has to give as many vectors, of the given
    dimension, in order. Tasks run side by side and are repeated by Spark when they fail."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for at in range(0, len(texts), batch):
                part = texts.iloc[at : at + batch].tolist()
                got = embedder(part)
                if len(got) != len(part) or any(len(v) != dimension for v in got):
                    raise ValueError("the embedder gave another number or length of vectors")
                out += [np.asarray(v, np.float32) for v in got]
            yield pd.Series(out, index=texts.index, dtype=object)

    return rows.withColumn("embedding", run(F.col(text_col)))


def with_cached(rows: DataFrame, cache: DataFrame, *, model: str, dimension: int, text_col: str = "text") -> DataFrame:
    """Add ``key`` and ``cached``, the vector found in ``cache`` (key, vector); one of another dimension is a miss."""
    keyed = rows.withColumn("key", cache_key("", model, F.col(text_col)))
    return keyed.join(cache.where(right_dimension(F.col("vector"), dimension)).withColumnRenamed("vector", "cached"), "key", "left")


def through_cache(
    rows: DataFrame, cache: DataFrame, embedder: Callable[[list[str]], list], *, model: str, dimension: int, text_col: str = "text", batch: int = 96,
) -> tuple[DataFrame, DataFrame]:
    """Rows with ``key``, ``hit`` and ``embedding``, and the next version of the cache (key, vector).

    Each missing text is embedded once, however many rows have it, and written before both results read it. Vectors of another
    dimension go from the cache, also where their key has one that stays; of several that could stay it is the least. Null texts
    have no vector.
    """
    one = cache.where(right_dimension(F.col("vector"), dimension)).groupBy("key").agg(F.min("vector").alias("vector"))
    found = with_cached(rows, one, model=model, dimension=dimension, text_col=text_col)
    missing = found.where(F.col("cached").isNull() & F.col(text_col).isNotNull()).groupBy("key").agg(F.min(text_col).alias("text"))
    new = materialize(embed(missing, embedder, dimension=dimension, batch=batch).select("key", F.col("embedding").alias("vector")), "vectors")
    whole = found.join(new, "key", "left").withColumns({"hit": F.col("cached").isNotNull(), "embedding": F.coalesce("cached", "vector")}).drop("cached", "vector")
    return whole, one.select("key", F.col("vector").cast("array<float>").alias("vector")).unionByName(new)
