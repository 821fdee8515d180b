"""Vectors as packed whole numbers: shared by the operators on quantised vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 1 << 62


def finite(vec_col: str) -> Column:
    """Whether the vector and all of its components are there and finite."""
    v = F.col(vec_col).cast("array<double>")
    return F.coalesce(F.col(vec_col).isNotNull()
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def quantised(df: DataFrame, vec_col: str, scale: int) -> DataFrame:
    """The rows of finite vectors with ``vec_col`` as the bytes of
    ``floor(scale * x)`` (8-byte whole numbers), and ``size``, their number.
    Components of 2^62 / scale or more raise an error: they fit no result."""
    at = df.columns.index(vec_col)
    fields = [f for f in df.schema.fields if f.name != vec_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{vec_col}` binary", "size int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(flat) and np.abs(flat).max() >= LIMIT:
                raise OverflowError(f"a component of {vec_col} has no 64-bit whole number")
            whole, ends = flat.astype("<i8"), np.cumsum(size)
            packed = pa.array([whole[e - n:e].tobytes() for e, n in zip(ends, size)], pa.binary())
            keep = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*keep, packed, pa.array(size.astype(np.int32))], names=[*names, vec_col, "size"])

    return df.where(finite(vec_col)).withColumn(vec_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, schema)


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Packed vectors as rows of ``width`` whole numbers; shorter ones end in zeros."""
    blobs = col.to_pylist()
    if all(len(b) == 8 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i8").reshape(len(blobs), width)
    return np.frombuffer(b"".join(b.ljust(8 * width, b"\0") for b in blobs), "<i8").reshape(len(blobs), width)


def widest(values: np.ndarray) -> int:
    return int(np.abs(values).max()) if values.size else 0
