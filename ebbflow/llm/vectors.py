"""What the two vector operators share: which vectors take part, and how they travel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a direction: neither null, empty nor zero, and all components finite."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column, all of one length, in double precision."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that no square overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """All products of the unit rows of ``x`` and ``y``. Those next to the threshold are summed again in one fixed order,
    so that a pair is judged alike in whichever blocks it meets."""
    out = x @ y.T
    r, c = np.nonzero(np.abs(out - threshold) < 1e-9)
    out[r, c] = (x[r] * y[c]).sum(1)
    return out
