"""Connected components of an edge table by alternating star steps.

Kiveris et al. 2014: a large star hangs the larger neighbours of a node under
its smallest one, a small star hangs the node itself and its smaller
neighbours there; the edge set shrinks to one star per component.  Minima are
group-bys with partial aggregation, so a hub is not gathered anywhere; every
round's edges are written, and the driver only sees their number and checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` -> ``(node, comp)`` for every node that has an edge to
    another node; ``comp`` is the smallest node of its component."""
    def pin(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
        df = checkpoint(df, observe=seen)
        return df, (seen["n"], str(seen["h"]))

    cur, mark = pin(edges.where(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())     # u > v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        cur, now = pin(small)
        if now == mark:
            break
        mark = now
    return (cur.select(F.col("a").alias("node"), F.col("b").alias("comp"))
            .unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()))
