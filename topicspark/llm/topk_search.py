"""Operator 12: exact top-k by inner product, candidates by descending length.

Components become whole numbers ``floor(scale * x)``, so scores are exact.

1. All rows are placed by descending length.  Of equal vectors only the
   ``k + 1`` smallest ids go on as candidates: no other copy can be among a
   query's first ``k``.
2. The vectors are rotated by the singular vectors of the candidates (from the
   summed ``d x d`` products), so the first components carry most of a product.
3. Queries are cut into blocks.  Every block meets the longest candidates first
   (``head``); each query's k-th score there is its first bound.  The others
   meet a block only where length times length reaches a bound of the block.
4. A task holds one block of queries and streams a stripe of the candidates in
   descending length.  A product of the first rotated components plus
   ``|rest of q| * |rest of p|`` (Cauchy-Schwarz) bounds a score from above;
   pairs below the bound go, the others take more components, and the rest is
   scored in whole numbers.  The task ends when length times length falls below
   all bounds.  It keeps ``k`` rows per query.
5. The rows of the stripes are merged per query.

Defined results: rows whose vector is null or holds null or non-finite
components take no part; a query is compared with every row but itself, so a
row repeated with its id is a candidate; repeated queries each get their rows;
a null id is a candidate (last among ties), never a query; shorter vectors end
in zeros; zero and empty vectors score 0; extra columns are ignored; an empty
table gives no rows.  Scores beyond 64 bits raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint
from topicspark.llm.vecio import matrix, quantised, widest
from topicspark.operators.ranking import with_global_index

K, SCALE, EVERY = 20, 64, 20
HEAD = 4096               # longest candidates that give the first bounds
STRIPE = 1 << 20          # candidates a task streams at most
QUERY_BLOCK = 8192        # queries a task holds at most
CELLS = 16                # query blocks at least, where there are enough queries
TILE = (512, 2048)        # queries and candidates multiplied at a time
STAGES = (0.125, 0.25, 0.5)   # shares of the rotated components before a bound is tried
LAST = np.iinfo(np.int64).max


def rotation(cands: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all candidates, strongest first."""
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column(0), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)),
                                          pa.array(list(total), pa.list_(pa.float64()))], names=["i", "g"])

    total = np.zeros((width, width))
    if width:
        rows = cands.select("vec").mapInArrow(gram, "i int, g array<double>") \
            .select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")) \
            .groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("g"))
        for r in rows.collect():                                        # width x width, no more
            total[r.i] = r.g
    vectors = np.linalg.eigh((total + total.T) / 2)[1] if width else total
    return np.ascontiguousarray(vectors[:, ::-1])


class Best:
    """The first ``k`` candidates of every query of a block."""

    def __init__(self, n: int, k: int, score: np.ndarray, tie: np.ndarray):
        self.k, self.bound, self.tie = k, score, tie            # a candidate must beat (score, tie)
        self.q = np.zeros(0, np.int64)
        self.score, self.id, self.idx = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, q, score, ids, idx) -> None:
        better = (score > self.bound[q]) | ((score == self.bound[q]) & (ids <= self.tie[q]))
        if not better.any():
            return
        mark = np.zeros(len(self.bound), bool)
        mark[q[better]] = True
        old = mark[self.q]                                      # only the queries that gain rows are ranked anew
        kept = [a[~old] for a in (self.q, self.score, self.id, self.idx)]
        q, score, ids, idx = (np.concatenate([a[old], new[better]]) for a, new in
                              ((self.q, q), (self.score, score), (self.id, ids), (self.idx, idx)))
        order = np.lexsort((idx, ids, -score, q))
        q, score, ids, idx = q[order], score[order], ids[order], idx[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        full, keep = rank == self.k - 1, rank < self.k
        self.bound[q[full]], self.tie[q[full]] = score[full], ids[full]
        self.q, self.score, self.id, self.idx = (np.concatenate([a, new[keep]]) for a, new in
                                                 zip(kept, (q, score, ids, idx)))


class Block:
    """One block of queries against candidates in descending length."""

    def __init__(self, x, turned, idx, ids, best: Best):
        self.x, self.turned, self.idx, self.ids, self.best = x, turned, idx, ids, best
        self.cuts = [max(1, math.ceil(x.shape[1] * s)) for s in STAGES] if x.shape[1] else []
        self.rest = [np.sqrt((turned[:, c:] ** 2).sum(1)) for c in self.cuts]
        self.length = np.sqrt((turned ** 2).sum(1))
        self.top = widest(x)

    def meet(self, x, turned, idx, ids) -> bool:
        """Take in candidates; false if no later, shorter one can count."""
        length = np.sqrt((turned ** 2).sum(1))
        slack = 1e-9 * self.length * (length.max() if len(length) else 0.0) + 1e-6
        reach = self.length * (length.max() if len(length) else 0.0) + slack
        live = np.flatnonzero(reach >= self.best.bound)
        if not len(live):
            return False
        rest = [np.sqrt((turned[:, c:] ** 2).sum(1)) for c in self.cuts]
        exact = self.top * widest(x) * max(x.shape[1], 1) < 1 << 53
        for a in range(0, len(live), TILE[0]):
            rows = live[a:a + TILE[0]]
            for b in range(0, len(x), TILE[1]):
                cols = np.arange(b, min(len(x), b + TILE[1]))
                self._tile(rows, cols, x, turned, rest, idx, ids, slack, exact)
        return True

    def _tile(self, rows, cols, x, turned, rest, idx, ids, slack, exact) -> None:
        need = self.best.bound[rows] - slack[rows]
        open_ = np.ones((len(rows), len(cols)), bool)
        if np.isfinite(need).any() and self.cuts:
            c = self.cuts[0]
            part = self.turned[rows, :c] @ turned[cols, :c].T
            open_ = part + self.rest[0][rows][:, None] * rest[0][cols][None, :] >= need[:, None]
        i, j = np.nonzero(open_)
        if not len(i):
            return
        if len(i) * 8 > open_.size and exact:                      # few pairs went: one product is cheaper
            score = self.x[rows].astype(np.float64) @ x[cols].astype(np.float64).T
            score[~open_] = -np.inf
            score[idx[cols][None, :] == self.idx[rows][:, None]] = -np.inf
            if len(cols) > self.best.k:
                least = np.partition(score, -self.best.k, axis=1)[:, -self.best.k]
                open_ = score >= least[:, None]
            i, j = np.nonzero(open_ & np.isfinite(score))
            self.best.add(rows[i], score[i, j].astype(np.int64), ids[cols[j]], idx[cols[j]])
            return
        value = (self.turned[rows[i], :self.cuts[0]] * turned[cols[j], :self.cuts[0]]).sum(1) if self.cuts else None
        for s in range(1, len(self.cuts)):
            lo, hi = self.cuts[s - 1], self.cuts[s]
            value = value + np.einsum("ij,ij->i", self.turned[rows[i], lo:hi], turned[cols[j], lo:hi])
            on = value + self.rest[s][rows[i]] * rest[s][cols[j]] >= need[i]
            i, j, value = i[on], j[on], value[on]
        other = idx[cols[j]] != self.idx[rows[i]]
        i, j = i[other], j[other]
        if not len(i):
            return
        if exact:
            score = np.einsum("ij,ij->i", self.x[rows[i]].astype(np.float64), x[cols[j]].astype(np.float64)).astype(np.int64)
        else:
            whole = (self.x[rows[i]].astype(object) * x[cols[j]].astype(object)).sum(1)
            score = np.array([int(v) for v in whole], dtype=np.int64)
        self.best.add(rows[i], score, ids[cols[j]], idx[cols[j]])


OUT = "q bigint, query_id bigint, idx bigint, cand_id bigint, score bigint"


def search(cells: DataFrame, width: int, turn: np.ndarray, k: int) -> DataFrame:
    """``cells (cell, kind, idx, id, vec, bound, tie)`` sorted by cell, kind
    (0 queries, 1 candidates) and idx -> the best ``k`` rows per query and cell."""
    def flush(block: Block | None) -> Iterator[pa.RecordBatch]:
        if block is not None and len(block.best.q):
            b = block.best
            none = b.id == LAST
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.idx[b.q]), pa.array(block.ids[b.q]), pa.array(b.idx), pa.array(b.id, mask=none), pa.array(b.score)],
                names=["q", "query_id", "idx", "cand_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block, more = None, [], None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            at, kind, idx = (batch.column(i).to_numpy() for i in range(3))
            ids = batch.column(3).fill_null(LAST).to_numpy()
            cuts = np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1
            for s, e in zip([0, *cuts], [*cuts, len(at)]):
                if at[s] != cell:
                    yield from flush(block)
                    cell, held, block, more = at[s], [], None, True
                if kind[s] == 1 and not more:
                    continue
                x = matrix(batch.column(4).slice(s, e - s), width)
                turned = x.astype(np.float64) @ turn
                if kind[s] == 0:
                    bound = batch.column(5).slice(s, e - s).to_numpy(zero_copy_only=False).astype(np.float64)
                    tie = batch.column(6).slice(s, e - s).fill_null(LAST).to_numpy()
                    held.append((x, turned, idx[s:e], ids[s:e], np.where(np.isnan(bound), -np.inf, bound), tie))
                    continue
                if block is None:
                    if not held:
                        continue
                    parts = [np.concatenate(p) for p in zip(*held)]
                    block, held = Block(*parts[:4], Best(len(parts[0]), k, parts[4], parts[5].copy())), []
                more = block.meet(x, turned, idx[s:e], ids[s:e])
        yield from flush(block)

    return cells.mapInArrow(run, OUT)


def dealt(cands: DataFrame, needs: list[tuple[float, int]], stripe: int, head: int) -> DataFrame:
    """``(cell, kind, idx, id, vec, ..)``: a candidate once per query block
    whose bound its length reaches.  ``needs`` holds the blocks by rising bound."""
    least = np.array([n for n, _ in needs])
    names = np.array([b for _, b in needs], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = np.searchsorted(least, batch.column(3).to_numpy() * (1 + 1e-9) + 1e-6, "right")
            cell = batch.column(0).to_numpy() // head                       # short runs of the order dealt over the stripes
            for b in range(int(reach.max()) if len(reach) else 0):
                rows = np.flatnonzero(reach > b)
                got = batch.take(pa.array(rows))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[b] * stripe + cell[rows] % stripe), pa.array(np.ones(n, np.int32)), got.column(0), got.column(1),
                     got.column(2), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int64())],
                    names=["cell", "kind", "idx", "id", "vec", "bound", "tie"])

    return cands.select("idx", "id", "vec", "len").mapInArrow(
        run, "cell bigint, kind int, idx bigint, id bigint, vec binary, bound double, tie bigint")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id",
          vec_col: str = "embedding", head: int = HEAD, query_block: int = QUERY_BLOCK, stripe: int = STRIPE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the rows whose id ``every`` divides."""
    rows = quantised(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")), "vec", scale)
    rows = with_length(rows)
    order = [F.col("len").desc(), F.col("vec").asc(), F.col("id").asc_nulls_last()]
    seen = {"n": F.count(F.lit(1)), "most": F.max("size"), "queries": F.count(F.when(F.col("id") % every == 0, 1))}
    placed = checkpoint(with_global_index(rows, order, "idx"), observe=seen)
    width, n_queries = seen["most"] or 0, seen["queries"]
    copies = Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last(), "idx")
    cands = checkpoint(placed.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1)
                       .select("idx", "id", "vec", "len"))
    turn = rotation(cands, width)
    size = max(1, min(query_block, -(-n_queries // CELLS)))
    queries = placed.where(F.col("id") % every == 0).select("idx", "id", "vec", "len")
    queries = checkpoint(with_global_index(queries, [F.col("idx").asc()], "qpos")
                         .withColumn("block", F.floor(F.col("qpos") / size).cast("bigint")).drop("qpos"))
    blocks = -(-n_queries // size) if n_queries else 0
    order = ["cell", "kind", "idx"]

    def cells(held: DataFrame, met: DataFrame, stripes: int) -> DataFrame:
        spread = held.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        both = spread.select((F.col("block") * stripes + F.col("stripe")).alias("cell"), F.lit(0).alias("kind"), "idx", "id", "vec", "bound", "tie").unionByName(met)
        return both.repartition(max(1, blocks * stripes), "cell").sortWithinPartitions(*order)

    opened = queries.withColumn("bound", F.lit(None).cast("double")).withColumn("tie", F.lit(None).cast("bigint"))
    first = cands.where(F.col("idx") < head)
    found = checkpoint(search(cells(opened, dealt(first, [(0.0, b) for b in range(blocks)], 1, head), 1), width, turn, k))
    last = found.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bound"),
                                  F.max_by(F.coalesce("cand_id", F.lit(LAST)), F.struct(-F.col("score"), F.coalesce("cand_id", F.lit(LAST)))).alias("tie")) \
        .where(F.col("n") == k).select("q", F.col("bound").cast("double"), "tie")
    opened = checkpoint(queries.join(last.withColumnRenamed("q", "idx"), "idx", "left"))
    # the length a candidate needs to count for some query of the block: one number per block
    need = F.when(F.col("bound").isNull(), F.lit(0.0)).when(F.col("len") > 0, F.col("bound") / F.col("len")).otherwise(
        F.when(F.col("bound") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    needs = sorted((max(0.0, r.need * (1 - 1e-9)), r.block) for r in opened.groupBy("block").agg(F.min(need).alias("need")).collect())
    stripes = max(1, -(-seen["n"] // stripe))
    later = search(cells(opened, dealt(cands.where(F.col("idx") >= head), needs, stripes, head), stripes), width, turn, k)
    merged = found.unionByName(later)
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("cand_id").asc_nulls_last(), F.col("idx").asc())
    return (merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("cand_id").alias("vec_id"), "score"))


def with_length(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy()
            width = int(size.max()) if len(size) else 0
            x = matrix(batch.column(1), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt((x ** 2).sum(1)))], names=["id", "vec", "size", "len"])

    return rows.select("id", "vec", "size").mapInArrow(run, "id bigint, vec binary, size int, len double")
