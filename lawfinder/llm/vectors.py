"""Vectors as whole numbers, shared by the operators that must be exact.

A component ``c`` becomes ``floor(256 * c)``. Rows whose vector is null, or
holds a null, a non-finite component or one whose whole number needs more
than 64 bits, have none and are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 256
_BEYOND = float(2**63)


def whole_numbers(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``x``, the vector of ``embedding`` in whole numbers, for each row that has one."""
    scaled = rows.select(*keep, F.transform(F.col("embedding").cast("array<double>"), lambda c: c * F.lit(float(SCALE))).alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(_BEYOND)))
    return scaled.where(sound).withColumn("x", F.transform("x", lambda c: F.floor(c).cast("long")))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column of vectors of one length as an array of rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as high and low 32 bits, whose sums over up to 2^31 rows are exact in 64 bits."""
    return x >> 32, x & 0xFFFFFFFF


def joined_halves(high: int, low: int) -> int:
    return (int(high) << 32) + int(low)


def squared_sum(x: np.ndarray) -> list[int]:
    """Exact sum of squares of each row of whole numbers, of any size."""
    most = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
    wide = x if most * most * max(1, x.shape[1]) < 1 << 63 else x.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def long_or_null(values: list[int]) -> pa.Array:
    """Whole numbers as longs; null where one needs more bits."""
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in values], pa.int64())
