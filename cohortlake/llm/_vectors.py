"""Checks on vector columns, and arrays from Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not zero, and of finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """A list column whose lists are equally long, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(n, -1) if n else np.empty((0, 0), dtype)


def hashed_sample(df: DataFrame, key: str, vector: str, most: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of the ``most`` rows of least hash of the key, of ``total`` rows: the same for the same rows, whatever tasks read them."""
    h = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40))
    share = min(1.0, (most + 6 * most**0.5 + 64) / max(1, total))  # all but surely enough rows
    picked = df.select(h.alias("_h"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("_h") < int(share * (1 << 40)))
    rows = picked.orderBy("_h", "_k", "_v").limit(most).toArrow()
    return rows["_k"].to_numpy(), matrix(rows["_v"])
