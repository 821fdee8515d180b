"""Operator 4: conflict-constrained best-fit packing of documents into bins.

An item is the words of a document plus one end.  A document longer than a bin
is cut: full pieces fill bins of their own, the rest is an item.  Bins are kept
ordered by residual space and carry a bitmap of their duplicate clusters and
bitmaps of their sources (plane k: sources with more than k documents in the
bin).  An item goes into the tightest bin that still holds it and has no
conflict: the search starts at the smallest sufficient residual and goes on to
the successor until a compatible bin is found; failing that, a bin is opened.

Items are dealt, largest first, round-robin over groups of at most
``group_rows`` items by their place in one global order, so no group grows with
the corpus or with a hot source; each group is packed by one task.

Defined results: a null or empty text is an item of size 1 without a cluster;
a null source conflicts with nothing; equal texts are one duplicate cluster
and never share a bin; repeated rows are packed each on their own; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from topicspark.llm import textio as T
from topicspark.operators.ranking import with_global_index

CAPACITY = 2048
PER_SOURCE = 2
GROUP_ROWS = 8192
SLICE = 1 << 20           # bytes of text worked at a time; the working memory is some times as many
SCHEMA = ("doc_id string, piece int, word_from bigint, word_to bigint, size bigint, bin_id bigint, "
          "bin_slot int, source string, cluster string")


@F.arrow_udf(LongType())
def item_size(texts: pa.Array) -> pa.Array:
    """Words of each text plus one end."""
    data, off = T.text_bytes(texts)
    out = np.ones(len(off) - 1, np.int64)
    for i, j in T.slices(off, SLICE):
        d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        inside = ~T._SPACE[d]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = o[:-1][o[:-1] < len(d)]
        begins[first] |= inside[first]
        total = np.zeros(len(d) + 1, np.int32)         # a text has fewer than 2^31 bytes
        np.cumsum(begins, out=total[1:])
        out[i:j] += total[o[1:]] - total[o[:-1]]
    return pa.array(out)


class Bins:
    """Open bins ordered by (residual, number)."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.filled: list[int] = []

    def open(self) -> int:
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.filled.append(0)
        return len(self.filled) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """``source`` and ``cluster`` are single bits, or 0.  Returns (bin, slot)."""
        order, last = self.order, self.per_source - 1
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not (self.clusters[b] & cluster or self.sources[b][last] & source):
                break
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = self.capacity, self.open()
        self.clusters[b] |= cluster
        carry = source
        planes = self.sources[b]
        for k in range(self.per_source):
            planes[k], carry = planes[k] | carry, planes[k] & carry
        slot = self.filled[b]
        self.filled[b] += 1
        if residual > size:
            insort(order, (residual - size, b))
        return b, slot


def pack_group(part: pd.DataFrame, capacity: int, per_source: int) -> Iterator[dict]:
    """Pack one group, items by decreasing size of what is left of them."""
    part = part.assign(rest=part["size"] % capacity).sort_values(
        ["rest", "idx"], ascending=[False, True], kind="stable")
    bits: dict = {}
    bins = Bins(capacity, per_source)
    for r in part.itertuples(index=False):
        source = 0 if r.source is None or r.source != r.source else 1 << bits.setdefault(("s", r.source), len(bits))
        cluster = 0 if r.cluster is None or r.cluster != r.cluster else 1 << bits.setdefault(("c", r.cluster), len(bits))
        pieces = r.size // capacity
        for p in range(pieces):
            b = bins.open()
            yield {"row": r, "piece": p, "from": p * capacity, "to": (p + 1) * capacity, "bin": b, "slot": 0}
        if r.rest:
            b, slot = bins.place(int(r.rest), source, cluster)
            yield {"row": r, "piece": pieces, "from": pieces * capacity, "to": r.size, "bin": b, "slot": slot}


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_rows: int = GROUP_ROWS,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: where it lies in its document and in which bin."""
    items = docs.select(
        F.col(id_col).cast("string").alias("doc_id"), item_size(F.col(text_col)).alias("size"),
        F.col(source_col).cast("string").alias("source"),
        F.when(F.length(text_col) > 0, F.xxhash64(text_col)).cast("string").alias("cluster"))
    placed = with_global_index(items, [F.col("size").desc(), F.col("doc_id").cast("bigint").asc_nulls_first(),
                                       F.col("source").asc_nulls_first(), F.col("cluster").asc_nulls_first()], "idx")
    groups = max(1, -(-placed.count() // group_rows))

    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        rows = [(p["row"].doc_id, p["piece"], p["from"], p["to"], p["to"] - p["from"], (g << 40) | p["bin"],
                 p["slot"], p["row"].source, p["row"].cluster) for p in pack_group(part, capacity, per_source)]
        return pd.DataFrame(rows, columns=["doc_id", "piece", "word_from", "word_to", "size", "bin_id",
                                           "bin_slot", "source", "cluster"])

    # ids and clusters pass pandas as strings, which keeps nulls and all 64 bits
    return (placed.withColumn("grp", F.col("idx") % F.lit(groups))
            .groupBy("grp").applyInPandas(run, SCHEMA)
            .withColumn("doc_id", F.col("doc_id").cast("bigint"))
            .withColumn("cluster", F.col("cluster").cast("bigint")))
