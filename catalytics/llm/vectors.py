"""Vector columns: which rows take part, and dense arrays of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec_id: Column, vector: Column) -> Column:
    """True for rows with an id and a non-empty vector of finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec_id.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & fine


def dense(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows x width; a shorter vector is padded with zeros (a missing component adds nothing to an inner product)."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(lengths), width), kind)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out
