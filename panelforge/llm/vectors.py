"""What the operators on vectors share: clean rows, matrices of a batch, exact products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of this size or more are taken as not finite: scaled, they would leave the range in which whole numbers are exact.
HUGE = float(1 << 50)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    size = lambda c: F.abs(c.cast("double"))
    return F.coalesce(F.forall(vector, lambda c: F.coalesce(size(c) < HUGE, F.lit(False)) & ~F.isnan(c)), F.lit(False))


def width(rows: DataFrame, vector_col: str) -> int:
    """The commonest length of vectors (the larger of equally common ones): one pass with partial sums; 0 for no rows."""
    sizes = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count("*").alias("n"))
    best = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A batch's list column of equal lengths as rows of a matrix, without a copy where Arrow allows it."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((len(column), 0), dtype=np.int64)


def reach(values: np.ndarray) -> int:
    """The largest absolute value, as a number of any size."""
    return max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers, exactly: in doubles where every sum stays below 2^53, else in Python's own numbers."""
    if reach(a) * reach(b) * max(1, a.shape[-1]) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def slices(batches: Iterator[pa.RecordBatch], dims: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` entries at the most, so that a worker's matrices stay small whatever the width."""
    step = max(1, most // max(1, dims))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
