"""Rank-peel: sequential greedy claiming computed as rounds over ranges of ranks.

The sequential procedure visits points in a total order; an unvisited point
becomes a *head* and claims every still unvisited member of its list.  With
``N(u)`` the list of ``u`` (which always holds ``u``), the outcome is fixed by:

- v is a head iff no head u with ``rank(u) < rank(v)`` has ``v`` in ``N(u)``;
- a non-head v belongs to the head of lowest rank whose list holds v.

Only forward edges ``u -> v`` with ``rank(u) < rank(v)`` matter.  The points are
cut into contiguous ranges of at most ``RANGE`` ranks.  In each round every
range settles in one task what it can: it walks its open points in rank order,
with its internal edges and the edges from points of earlier ranges.  A point
with a head before it is claimed, one with nothing undecided before it is a
head, the others wait.  The lowest open range always settles completely, so the
rounds follow the number of ranges and not the longest chain of points.  After
each round only the open points and their edges are written again; the driver
only sees the count of open points, observed in the same job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.ranking import with_global_index
from topicspark.session import checkpoint

UNDECIDED, HEAD, CLAIMED = 0, 1, 2
RANGE = 20_000            # points settled by one task
MIN_RANGES = 4


def _settle(part: pd.DataFrame) -> pd.DataFrame:
    """Settle one range.  Rows are its open points (``u`` null) and their
    edges (``u`` with its state: undecided or head)."""
    edges = part[part["u"].notna()].sort_values("v", kind="stable")
    nodes = np.sort(part.loc[part["u"].isna(), "v"].to_numpy(np.int64))
    u, v, state = edges["u"].to_numpy(np.int64), edges["v"].to_numpy(np.int64), edges["su"].to_numpy()
    first = np.searchsorted(v, nodes, "left")
    last = np.searchsorted(v, nodes, "right")
    place = np.searchsorted(nodes, u)
    inside = (place < len(nodes)) & (nodes[np.minimum(place, max(len(nodes) - 1, 0))] == u) if len(nodes) else np.zeros(0, bool)
    status = np.zeros(len(nodes), np.int64)
    status[first == last] = HEAD
    for i in np.flatnonzero(first < last):
        s, e = first[i], last[i]
        before = np.where(inside[s:e], status[np.minimum(place[s:e], len(nodes) - 1)], state[s:e])
        if (before == HEAD).any():
            status[i] = CLAIMED
        elif not (before == UNDECIDED).any():
            status[i] = HEAD
    return pd.DataFrame({"v": nodes, "status": status})


def rank_peel(edges: DataFrame, ranks: DataFrame, range_size: int = RANGE, min_ranges: int = MIN_RANGES) -> tuple[DataFrame, int]:
    """Greedy claiming.

    ``edges (u, v)``: v is in the list of u.  ``ranks (node, rnk)``: the
    visiting order (unique).  Returns ``((node, cluster_id), rounds)`` where
    ``cluster_id`` numbers the heads 0, 1, ... in visiting order.  A range's
    task holds ``range_size`` points and the edges into them: short lists allow
    wide and few ranges, which take fewer rounds.
    """
    order = checkpoint(with_global_index(ranks.select("node", "rnk"), [F.col("rnk").asc()], "idx").select("node", "idx"))
    n = order.count()
    width = max(1, min(range_size, -(-n // min_ranges)))
    u = order.select(F.col("node").alias("_un"), F.col("idx").alias("u"))
    v = order.select(F.col("node").alias("_vn"), F.col("idx").alias("v"))
    fwd = checkpoint(edges.select(F.col("u").alias("_un"), F.col("v").alias("_vn"))
                     .join(u, "_un").join(v, "_vn").where(F.col("u") < F.col("v")).select("u", "v").distinct())
    open_nodes = order.select(F.col("idx").alias("v"))
    open_edges = fwd.select("u", "v", F.lit(UNDECIDED).alias("su"))
    done, rounds, left = [], 0, n
    while left:
        rounds += 1
        rows = open_edges.unionByName(open_nodes.select(
            F.lit(None).cast("long").alias("u"), "v", F.lit(UNDECIDED).alias("su")))
        seen = {"open": F.sum((F.col("status") == UNDECIDED).cast("long"))}
        state = checkpoint(rows.groupBy(F.floor(F.col("v") / width).alias("_range"))
                           .applyInPandas(_settle, "v long, status long"), observe=seen)
        done.append(state.where(F.col("status") != UNDECIDED))
        left = seen["open"] or 0
        if left:
            open_nodes = state.where(F.col("status") == UNDECIDED).select("v")
            now = state.select(F.col("v").alias("u"), F.col("status").alias("_now"))
            # edges into open points; a claimed source says nothing, a head stays a head
            open_edges = checkpoint(
                open_edges.join(open_nodes, "v", "left_semi").join(now, "u", "left")
                .withColumn("su", F.coalesce("_now", F.col("su"))).where(F.col("su") != CLAIMED)
                .select("u", "v", F.col("su").cast("int").alias("su")))
    if not done:
        return ranks.select("node", F.lit(0).cast("long").alias("cluster_id")).limit(0), 0
    status = done[0]
    for d in done[1:]:
        status = status.unionByName(d)
    heads = checkpoint(status.where(F.col("status") == HEAD).select("v"))
    claims = fwd.join(heads.select(F.col("v").alias("u")), "u", "left_semi") \
        .join(heads, "v", "left_anti").groupBy("v").agg(F.min("u").alias("owner"))
    owners = heads.select("v", F.col("v").alias("owner")).unionByName(claims)
    ids = with_global_index(heads, [F.col("v").asc()], "cluster_id").select(F.col("v").alias("owner"), "cluster_id")
    return (owners.join(ids, "owner").join(order.withColumnRenamed("idx", "v"), "v")
            .select("node", "cluster_id"), rounds)
