"""What the operators on embeddings share: valid vectors, and blocks of vectors as binary rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import col

#: bytes of vectors in a block: with 64 rows to an Arrow batch, a task holds some tens of MB
BLOCK_BYTES = 1 << 19


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def is_valid(vector: Column) -> Column:
    """Neither null nor zero, and without null, NaN or infinite components."""
    v = as_doubles(vector)
    finite = F.forall(v, lambda x: F.abs(x) < F.lit(float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def in_range(vector: Column) -> Column:
    """A valid vector, scaled by a power of two where its squared length would over- or underflow; that leaves its cosines as they are.

    The scale is applied in two steps, since the whole of it may be out of range itself.
    """
    v = as_doubles(vector)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    power = F.floor(F.log2(F.aggregate(v, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))))
    half = F.floor(power / 2)
    scaled = F.transform(v, lambda x: x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - power))
    return F.when((square > 1e-280) & (square < 1e280), v).otherwise(scaled)


def block_rows(dim: int) -> int:
    return max(16, BLOCK_BYTES // (8 * dim))


def valid_rows(df: DataFrame, vec_id: str, vector: str, *more: Column) -> DataFrame:
    """Distinct ``(id, vec, dim, ...)`` of the rows that take part; -0.0 counts as 0.0, extreme vectors are scaled."""
    rows = df.where(is_valid(col(vector))).select(
        col(vec_id).alias("id"), F.transform(in_range(col(vector)), lambda x: x + 0.0).alias("vec"), *more
    )
    return rows.withColumn("dim", F.size("vec")).distinct()


def matrix(column) -> np.ndarray:
    """Rows of one Arrow list column of equal lengths as a matrix."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]
