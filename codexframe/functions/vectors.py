"""Vectors as arrays: checks, norms, and similarity in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def is_valid(v: Column, dim: int | None = None) -> Column:
    """Not null, of the dimension, and all components finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = v.isNotNull() & F.coalesce(finite, F.lit(False))
    return ok & (F.size(v) == dim) if dim is not None else ok


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in order in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def cosine_to(query: list[float]):
    """Cosine to one fixed vector as an Arrow function: a matrix product per batch, null for zero or null vectors."""
    q = np.asarray(query, np.float64)
    length = float(np.sqrt(q @ q))

    @F.pandas_udf(DoubleType())
    def score(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        usable = np.array([v is not None and len(v) == len(q) for v in vectors], bool)
        if usable.any() and length > 0:
            m = np.stack([np.asarray(v, np.float64) for v in vectors[usable]])
            sizes = np.sqrt((m * m).sum(1))
            out[usable] = np.where(sizes > 0, (m @ q) / np.where(sizes > 0, sizes, 1) / length, np.nan)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    # a filter on the score must not move below its evaluation, which would then run twice
    return score.asNondeterministic()
