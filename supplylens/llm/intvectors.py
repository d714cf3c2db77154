"""Vectors as whole numbers: ``floor(scale * x)`` of every component, packed as 64-bit integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: integers are held to this size, so that a long holds every one of them
LARGEST = 1 << 61


def _floors(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = column.flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            finite = np.isfinite(flat)
            wrong = np.concatenate([[0], np.cumsum(~finite)])
            good = ~column.is_null().to_numpy(zero_copy_only=False) & (wrong[bounds[1:]] == wrong[bounds[:-1]])
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(np.where(finite, flat, 0) * scale), -LARGEST, LARGEST).astype(np.int64)
            rows = np.flatnonzero(good)
            packed = [whole[bounds[r]:bounds[r + 1]] for r in rows]
            norms = [float(np.sqrt((v.astype(np.float64) ** 2).sum())) for v in packed]
            others = [batch.column(i).take(pa.array(rows)) for i, c in enumerate(batch.schema.names) if c != "embedding"]
            yield pa.RecordBatch.from_arrays(
                [*others, pa.array(number + rows), pa.array(sizes[rows].astype(np.int32)),
                 pa.array([v.tobytes() for v in packed], pa.binary()), pa.array(norms, pa.float64())],
                [*(c for c in batch.schema.names if c != "embedding"), "row", "dim", "v", "norm"])
            number += batch.num_rows
    return run


def integer_vectors(vectors: DataFrame, scale: int, *others: str) -> DataFrame:
    """``vec_id``, the columns ``others``, ``row`` (a number for each row), ``dim``, ``v`` and ``norm``.

    Rows whose vector is null or holds null or non-finite components are left out. Components
    count as doubles; integers outside of +-2**61 are held to that. Write the result before
    its ``row`` is used twice, as the numbers follow the partitions of this one run.
    """
    fields = "".join(f", {c} string" for c in others)
    return vectors.select(F.col("vec_id").cast("long"), *(F.col(f"`{c}`").cast("string").alias(c) for c in others),
                          F.col("embedding").cast("array<double>")).mapInArrow(
        _floors(scale), f"vec_id long{fields}, row long, dim int, v binary, norm double")


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Packed vectors of one length as rows."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.int64).reshape(len(column), dim)
