"""Vector functions; floats are widened before any arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, from -1 to 1; null for vectors without length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def right_dimension(v: Column, dimension: int) -> Column:
    return v.isNotNull() & (F.size(v) == dimension)


def cache_key(prefix: str, model: str, text: Column) -> Column:
    """Key of an embedding in a lookup table."""
    return F.concat(F.lit(f"{prefix}emb:v1:"), F.md5(F.concat_ws("|", F.lit(model), text)))


def vector_bytes(v: Column) -> Column:
    """Vectors as little-endian float32 bytes; null for an empty one."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or not len(x) else np.asarray(x, "<f4").tobytes())

    return run(v)


def vector_of_bytes(b: Column) -> Column:
    """Vectors of such bytes; null where their number isn't one of whole floats."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or not len(x) or len(x) % 4 else np.frombuffer(x, "<f4"))

    return run(b)
