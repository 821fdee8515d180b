"""The distributed global index equals a plain row_number over the same order."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from topicspark.operators.ranking import with_global_index


def test_global_index_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select(
        F.col("id"), (F.col("id") * 7919 % 101).alias("total"))
    order = [F.col("total").desc(), F.col("id").asc()]
    got = {r.id: r.idx for r in with_global_index(df, order, "idx").collect()}
    exp = {r.id: r.rn - 1 for r in df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).collect()}
    assert got == exp
    assert sorted(got.values()) == list(range(5000))
