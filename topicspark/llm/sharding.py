"""Operator 9: byte-balanced shards by Karmarkar-Karp differencing.

Equal texts are one indivisible group.  A partial partition is a vector of k
byte sums, one per shard; a single group starts as ``(bytes, 0, ..., 0)``.  The
two partial partitions with the largest spread are combined again and again,
one sorted descending and the other ascending, until one is left.

The groups are dealt by decreasing size over chunks of at most ``chunk_rows``
(their places in one global order), and each task differences one chunk into a
single partial partition.  The chunks' partial partitions are differenced the
same way, level by level, until one is left; only k numbers per chunk move.
The chunk of a row and the labels of the levels are joined back.

Defined results: a null text counts as empty; equal texts (null and empty
included) share a shard; repeated rows each take a slot; slots number the rows
of a shard by document id without gaps; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint
from topicspark.operators.ranking import with_global_index

SHARDS = 24
CHUNK_ROWS = 32768


def difference(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference ``(m, k)`` partial partitions into one.  Returns the label
    matrix ``(m, k)`` (final slot of each slot of each vector) and the sums."""
    m, k = vectors.shape
    order = np.argsort(vectors, axis=1, kind="stable")
    sums = {i: vectors[i][order[i]] for i in range(m)}             # ascending
    heap = [(-float(s[-1] - s[0]), i) for i, s in sums.items()]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []                     # children and the sort of the sums
    nxt = m
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]                      # slot j: j-th of a, (k-1-j)-th of b
        perm = np.argsort(total, kind="stable")
        sums[nxt] = total[perm]
        made.append((a, b, perm))
        heapq.heappush(heap, (-float(sums[nxt][-1] - sums[nxt][0]), nxt))
        nxt += 1
    label: dict[int, np.ndarray] = {nxt - 1: np.arange(k)}           # of a node's ascending slots
    for node in range(nxt - 1, m - 1, -1):
        a, b, perm = made[node - m]
        mine = np.empty(k, np.int64)
        mine[perm] = label.pop(node)
        label[a], label[b] = mine, mine[::-1]
    out = np.empty((m, k), np.int64)
    for i in range(m):
        out[i, order[i]] = label[i]
    return out, sums[nxt - 1]


def assign_groups(groups: DataFrame, shards: int = SHARDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``groups (key, bytes)`` -> ``(key, shard)``."""
    placed = with_global_index(groups, [F.col("bytes").desc(), F.col("key").asc()], "idx")
    n = placed.count()
    if n == 0:
        return groups.select("key", F.lit(0).alias("shard"))
    chunks = -(-n // chunk_rows)
    level = placed.select("key", "bytes", "idx", (F.col("idx") % F.lit(chunks)).alias("chunk"))

    def first(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx", kind="stable")
        start = np.zeros((len(part), shards))
        start[:, 0] = part["bytes"]
        label, sums = difference(start)
        return pd.DataFrame({"key": part["key"], "chunk": part["chunk"], "label": label[:, 0].astype("int32"),
                             "sums": [sums] + [None] * (len(part) - 1)})

    done = checkpoint(level.groupBy("chunk").applyInPandas(
        first, "key binary, chunk bigint, label int, sums array<double>"))
    result = done.select("key", "chunk", "label")
    vectors = done.where(F.col("sums").isNotNull()).select("chunk", "sums")
    while chunks > 1:
        up = -(-chunks // chunk_rows)

        def combine(key, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("chunk", kind="stable")
            label, sums = difference(np.stack(part["sums"].to_list()))
            return pd.DataFrame({"chunk": part["chunk"], "labels": list(label.astype("int32")),
                                 "up": part["up"], "sums": [sums] + [None] * (len(part) - 1)})

        step = checkpoint(vectors.withColumn("up", F.col("chunk") % F.lit(up)).groupBy("up").applyInPandas(
            combine, "chunk bigint, labels array<int>, up bigint, sums array<double>"))
        result = (result.join(step.select("chunk", "labels", "up"), "chunk")
                  .select("key", F.col("up").alias("chunk"), F.element_at("labels", F.col("label") + 1).alias("label")))
        vectors = step.where(F.col("sums").isNotNull()).select(F.col("up").alias("chunk"), "sums")
        chunks = up
    return result.select("key", F.col("label").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, chunk_rows: int = CHUNK_ROWS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    rows = checkpoint(rows)
    groups = rows.groupBy("key").agg(F.sum("size").cast("double").alias("bytes"))
    with_shard = rows.join(assign_groups(groups, shards, chunk_rows), "key")
    placed = with_global_index(with_shard, [F.col("shard").asc(), F.col("doc_id").asc_nulls_first(),
                                            F.col("key").asc()], "idx")
    starts = placed.groupBy("shard").agg(F.min("idx").alias("start"))   # one row per shard
    return (placed.join(F.broadcast(starts), "shard")
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (F.col("idx") - F.col("start")).alias("slot")))
