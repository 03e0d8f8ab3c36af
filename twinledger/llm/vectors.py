"""What the vector operators share: which vectors count, and bounded samples of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is neither null nor zero and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def sampled(vectors: DataFrame, column: str, rows: int) -> dict[int, np.ndarray]:
    """At most ``rows`` vectors, those with the least hash, as one matrix per dimension."""
    picked = vectors.select(column).orderBy(F.xxhash64(column)).limit(rows).collect()
    by_size: dict[int, list] = {}
    for (vector,) in picked:
        by_size.setdefault(len(vector), []).append(vector)
    return {d: np.array(found, np.float64) for d, found in by_size.items()}


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; none may be zero."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
