"""What the operators on embeddings share: which vectors count, their bytes, and unit rows in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, vec): a row for each vector that is not null, not zero and has finite components only; vec holds its components, little-endian:
    in single precision where that loses nothing, else in double. Negative zeros become zeros, so equal vectors have equal bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for vec_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                v = value.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if np.isfinite(v).all() and v.any():
                    ids.append(vec_id)
                    dims.append(len(v))
                    with np.errstate(over="ignore"):
                        short = v.astype("<f4")
                    out.append((short if (short == v).all() else v).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "dim", "vec"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(run, "vec_id long, dim int, vec binary")


def rows_of(column, dim: int) -> np.ndarray:
    """The components of a column of packed vectors in double precision, a row each."""
    packed = list(column)
    if all(len(v) == 4 * dim for v in packed):
        return np.frombuffer(b"".join(packed), "<f4").reshape(-1, dim).astype("<f8")
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype("<f8") for v in packed])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by the largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
