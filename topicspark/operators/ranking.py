"""Global positions in a total order, without funnelling rows into one task.

``row_number() over (order by ...)`` with no partition moves every row into a
single task.  Here the rows are range-partitioned and sorted per partition
(a distributed sort), each row takes its local position, and the only data
that meets in one place is one count per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.session import checkpoint


def with_global_index(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Attach a 0-based position in ``order`` (which must be a total order)."""
    staged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    # pin one partitioning: both uses below must see the same layout
    staged = checkpoint(staged)
    sizes = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a window over it is bounded by the partition count
    offsets = sizes.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"),
    ).fillna({"_off": 0})
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (
        staged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + local).cast("long"))
        .drop("_pid", "_mid", "_off")
    )
