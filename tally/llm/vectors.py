"""Integer vectors from a table of embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Integers up to here are exact as doubles.
EXACT = 1 << 53


def integer_vectors(table: DataFrame, vector: str = "embedding", scale: int = 256, **others: Column) -> DataFrame:
    """``uid, others, v``: every component as ``floor(scale * x)``, without rows
    whose vector is null or holds a null or non-finite component. ``uid`` numbers
    the rows (write the result before it is read twice)."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return table.filter(x.isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"), *[c.alias(name) for name, c in others.items()],
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers; shorter ones end in zeros."""
    n = len(column)
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((n, width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out
