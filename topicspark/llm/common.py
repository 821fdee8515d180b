"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.session import checkpoint  # noqa: F401  (written-table checkpoint)


def fold(id_col: str | Column, parts: int) -> Column:
    """``crc32(id as text) mod parts``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string")) % F.lit(parts)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unit_hash(col: Column, seed: int) -> Column:
    """A fixed pseudo-random number in [0, 1) per value."""
    return F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def arrow_rows(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` whose kernel yields dicts of arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in kernel(batch):
                yield to_batch(out, target)

    return df.mapInArrow(run, schema)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in schema:
        value = columns[f.name]
        if not isinstance(value, pa.Array):
            value = pa.array(value, type=f.type)
        elif value.type != f.type:
            value = value.cast(f.type)
        arrays.append(value)
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished, written steps now: its
    cleaner acts when the driver collects garbage."""
    import gc
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
