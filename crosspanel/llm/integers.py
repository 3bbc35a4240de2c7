"""Vectors as whole numbers, and products of them that are exact at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a component is multiplied by before it is rounded down, and the size from which it takes no part.
SCALE, LARGEST = 256, 2.0**56
MOST = 2**63 - 1


def scaled(vectors: DataFrame, vector_col: str, width: int | None = None) -> DataFrame:
    """``vectors`` with ``v``, the components as whole numbers (held as doubles), without the rows that can't have one."""
    v = F.col(f"`{vector_col}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < LARGEST))
    held = vectors.where(v.isNotNull() & (F.lit(True) if width is None else F.size(v) == width))
    return held.where(good).withColumn("v", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def _fitting(*parts: np.ndarray, factor: int = 1) -> tuple[np.ndarray, ...]:
    """The matrices in a type in which ``factor`` times their inner products are exact."""
    most = max((float(np.abs(p).max()) for p in parts if p.size), default=0.0)
    bound = factor * max(1, parts[0].shape[1]) * most * most
    if bound < 2**52:
        return parts
    if bound < 2**62:
        return tuple(p.astype(np.int64) for p in parts)
    return tuple(np.array([[int(x) for x in row] for row in p.tolist()], object).reshape(p.shape) for p in parts)


def _whole(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == object else x.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``: 64-bit integers, or Python's where those may not hold them."""
    a, b = _fitting(a, b)
    return _whole(a @ b.T)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, as ``products``."""
    a, b = _fitting(a, b, factor=4)
    return _whole((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :])


def clipped(x: np.ndarray) -> np.ndarray:
    """64-bit integers; larger ones become the largest."""
    return x if x.dtype == np.int64 else np.array([min(MOST, max(-MOST - 1, int(v))) for v in x.tolist()], np.int64)
