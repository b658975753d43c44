"""Arrow columns of vectors as numpy matrices, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm.tokens import spread


def dense(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of doubles with a row for each vector, shorter ones padded with zeros, and which rows
    are vectors: not null, and all components finite numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_list(pa.float64()))
    there = a.is_valid().to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(a), 0).to_numpy().astype(np.int64)
    values = a.flatten().to_numpy(zero_copy_only=False).astype(float)
    owner = np.repeat(np.arange(len(a)), lengths)
    out = np.zeros((len(a), dim))
    out[owner, spread(lengths)] = values
    whole = there.copy()
    whole[owner[~np.isfinite(values)]] = False
    out[~whole] = 0
    return out, whole


def is_vector(c: Column) -> Column:
    """Not null, and all components finite numbers."""
    broken = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~broken


def extent(vectors: DataFrame, column: str = "embedding") -> tuple[int, int]:
    """Rows, and components of the longest vector."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    return n, max(dim or 0, 1)
