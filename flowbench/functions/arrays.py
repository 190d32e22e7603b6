"""NumPy <-> Arrow conversions used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_of(batch: pa.RecordBatch, start: int, stop: int) -> np.ndarray:
    """Numeric columns ``start:stop`` of a batch as a (rows, columns) matrix."""
    if start == stop:
        return np.zeros((batch.num_rows, 0))
    return np.column_stack(
        [batch.column(i).to_numpy(zero_copy_only=False) for i in range(start, stop)]
    )


def matrix_of_lists(lists: pa.ListArray) -> np.ndarray:
    """A list column whose lists all have one length as a matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def lists_of(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a list column, one list per row, without copying rows one by one."""
    rows, columns = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * columns
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def vectors_of(matrix: np.ndarray) -> pa.StructArray:
    """A matrix as a column of dense vectors, in the fields of ``VectorUDT.sqlType()``."""
    rows = len(matrix)
    return pa.StructArray.from_arrays(
        [pa.array(np.ones(rows, np.int8)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int32())),
         lists_of(matrix.astype(np.float64))],
        names=["type", "size", "indices", "values"],
    )
