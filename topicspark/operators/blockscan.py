"""Exact top-k neighbours by a pruned block scan.

Both metrics obey the triangle inequality: the angle between unit vectors, and
the Hamming distance between signatures.

1. Some rows (by a hash of their id) serve as pivots.  Rows are ordered by
   their nearest pivot and cut into blocks of equal size, so a block holds
   similar rows and no hot value makes a block larger.  The rows of a candidate
   block that share a pivot have a centre and a radius.
2. A block of queries is scanned against the candidate block of the nearest
   centre (for a self join its own block).  Each query's k-th score is then a
   bound on the distance of its neighbours.
3. A candidate block is needed by a query block if some query is nearer to one
   of its centres than bound + radius; others are never sent.  A task holds one block of
   queries (in a large self join up to ``JOINED`` of them, so candidates are sent less often)
   with their best ``k`` and streams the needed blocks, nearest first, in stripes of bounded size; inside, each query again skips the blocks that
   its bound, by then tighter, rules out.
4. The best of the two scans are merged per query: at most ``k`` rows per query
   from the first scan and ``k`` per stripe from the second.

Dot products are taken in single precision first.  Candidates within its error
of a bound are scored again in double precision, in one fixed order of summation,
and ranked by score, then id, so the lists do not depend on blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.ranking import with_global_index
from topicspark.session import checkpoint

BLOCK_ROWS = 8192             # rows of a block at most
BLOCK_BYTES = 1 << 22         # or this many bytes
CELLS = 16                    # blocks that even a small table is cut into, where they keep 256 rows
MAX_BLOCKS = 1 << 14          # candidate blocks: their centres are sent to every task
PIVOTS = 1 << 10
STRIPE = 1 << 17              # candidate rows that a task streams at most
JOINED = 4                    # blocks of a large self join whose queries are held together
SPREAD = 4                    # partitions a cell (query block and stripe)
TILE = 128                    # queries scored at a time: the working memory of a task is some tiles of scores
NEST = 1 << 13                # pairs whose words are compared at a time, within the processor's cache
OUT = "q long, n long, score double, sim double"


class Cosine:
    """Unit vectors; score is the dot product, distance the angle."""
    item, near, slack = "<f8", 1e-9, 1e-6

    @staticmethod
    def scores(a, b):
        return a @ b.T

    @staticmethod
    def rough(x):
        return x.astype(np.float32)

    @staticmethod
    def error(a, b):
        """How far two dot products of rough rows may be off, at most."""
        longest = [np.sqrt((x * x).sum(1).max()) if len(x) else 0.0 for x in (a, b)]
        return 2 * (a.shape[1] + 8) * 2.0 ** -24 * longest[0] * longest[1] + Cosine.near

    @staticmethod
    def exact(a, b):
        return (a * b).sum(axis=1)

    @staticmethod
    def distance(score):
        return np.arccos(np.clip(score, -1.0, 1.0))

    @staticmethod
    def centre(x):
        c = x.sum(0)
        size = np.sqrt((c * c).sum())
        return c / size if size > 0 else x[0]


class Hamming:
    """Signatures as 64-bit words; score is the negative Hamming distance."""
    item, near, slack = "<u8", 0.0, 0.0

    @staticmethod
    def scores(a, b):
        kind = np.float32 if 64 * a.shape[1] < 1 << 24 else np.float64         # whole numbers that it holds exactly
        out, words = np.zeros((len(a), len(b)), kind), np.ascontiguousarray(b.T)
        rows = max(1, NEST // max(1, len(b)))
        for s in range(0, len(a), rows):
            x = np.empty((len(a[s:s + rows]), len(b)), np.uint64)
            bits = np.empty(x.shape, np.uint8)
            for first in range(0, a.shape[1], 1 << 9):         # 64 bits a word: the sum stays within 16 bits
                total = np.zeros(x.shape, np.uint16)
                for w in range(first, min(a.shape[1], first + (1 << 9))):
                    np.bitwise_xor(a[s:s + rows, w][:, None], words[w][None, :], out=x)
                    total += np.bitwise_count(x, out=bits)
                out[s:s + rows] -= total
        return out

    @staticmethod
    def rough(x):
        return x

    @staticmethod
    def error(a, b):
        return 0.0

    @staticmethod
    def exact(a, b):
        return -np.bitwise_count(a ^ b).sum(axis=1).astype(np.float64)

    @staticmethod
    def distance(score):
        return -np.asarray(score, np.float64)

    @staticmethod
    def centre(x):
        bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
        return np.packbits(bits.sum(0) * 2 > len(x)).view("<u8")


METRICS = {"cosine": Cosine, "hamming": Hamming}


def rows_of(col, item: str) -> np.ndarray:
    blobs = col.to_pylist() if isinstance(col, (pa.Array, pa.ChunkedArray)) else list(col)
    return np.frombuffer(b"".join(blobs), item).reshape(len(blobs), -1)


def packed(df: DataFrame, kind: str) -> DataFrame:
    """``(id, x array[, v array])`` -> ``(id, vec binary, pay binary)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [batch.column(0)]
            for i in range(1, batch.num_columns):
                col = batch.column(i)
                flat = col.flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 0)
                if kind == "hamming" and i == 1:
                    rows = rows.astype("<u4")
                    if rows.shape[1] % 2:
                        rows = np.hstack([rows, np.zeros((len(rows), 1), "<u4")])
                else:
                    rows = rows.astype("<f8")
                out.append(pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary()))
            if len(out) == 2:
                out.append(pa.nulls(batch.num_rows, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["id", "vec", "pay"])

    cols = ["id", "x"] + (["v"] if "v" in df.columns else [])
    return df.select(F.col("id").cast("long"), *cols[1:]).mapInArrow(run, "id long, vec binary, pay binary")


def pivots(rows: DataFrame, kind: str, n: int) -> np.ndarray:
    """Vectors of the ``n`` rows whose hashed ids come first (``n`` is bounded)."""
    got = rows.select("vec", F.xxhash64("id").alias("_h"), "id").orderBy("_h", "id").limit(n).collect()
    return rows_of([bytes(r.vec) for r in got], METRICS[kind].item)


def placed(rows: DataFrame, kind: str, marks: np.ndarray, size: int) -> DataFrame:
    """``(id, vec, pay, leaf, block)``: rows in order of their nearest pivot, ``size`` to a block."""
    metric = METRICS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column(1), metric.item)
            leaf, best = np.zeros(len(x), np.int64), np.zeros(len(x))
            for s in range(0, len(x), TILE):
                score = metric.scores(x[s:s + TILE], marks)
                leaf[s:s + TILE], best[s:s + TILE] = score.argmax(1), score.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(-best)], names=["id", "vec", "pay", "leaf", "far"])

    near = rows.mapInArrow(run, "id long, vec binary, pay binary, leaf long, far double")
    got = with_global_index(near, [F.col("leaf").asc(), F.col("far").asc(), F.col("id").asc()], "idx")
    return checkpoint(got.select("id", "vec", "pay", "leaf", F.floor(F.col("idx") / size).cast("long").alias("block")))


def summaries(blocks: DataFrame, kind: str) -> DataFrame:
    """``(block, leaf, centre, radius)``: the rows of a block that share their
    nearest pivot lie within ``radius`` of their centre.  A block that holds the
    end of one group and the start of another has a ball for each."""
    metric = METRICS[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = rows_of(pdf["vec"], metric.item)
        centre = metric.centre(x)
        far = max(float(metric.distance(metric.scores(x[s:s + TILE], centre[None])).max()) for s in range(0, len(x), TILE))
        return pd.DataFrame({"block": pdf["block"][:1], "leaf": pdf["leaf"][:1], "centre": [centre.tobytes()], "radius": [far + metric.slack]})

    return blocks.select("block", "leaf", "vec").groupBy("block", "leaf") \
        .applyInPandas(run, "block long, leaf long, centre binary, radius double")


class Best:
    """The first ``k`` candidates of every query of a block, by score, then id:
    a row of ``k`` places for each query, of which ``held`` are taken."""

    def __init__(self, bound: np.ndarray, tie: np.ndarray, k: int):
        self.k, self.bound, self.tie = k, bound, tie
        self.held = np.zeros(len(bound), np.int64)
        self.n, self.score, self.sim = (np.zeros((len(bound), k), t) for t in (np.int64, float, float))

    def add(self, q, n, score, sim) -> None:
        better = (score > self.bound[q]) | ((score == self.bound[q]) & (n < self.tie[q]))
        if not better.any():
            return
        q, n, score = q[better], n[better], score[better]
        sim = score if sim is None else sim(better)
        mine = np.unique(q)
        at, place = np.nonzero(np.arange(self.k) < self.held[mine][:, None])
        old = mine[at]
        q, n, score, sim = (np.concatenate(both) for both in (
            (old, q), (self.n[old, place], n), (self.score[old, place], score), (self.sim[old, place], sim)))
        order = np.lexsort((n, -score, q))
        q, n, score, sim = q[order], n[order], score[order], sim[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
        full, keep = rank == self.k - 1, rank < self.k
        self.bound[q[full]], self.tie[q[full]] = score[full], n[full]
        q, rank = q[keep], rank[keep]
        self.n[q, rank], self.score[q, rank], self.sim[q, rank] = n[keep], score[keep], sim[keep]
        self.held[mine] = np.bincount(np.searchsorted(mine, q), minlength=len(mine))

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        q, place = np.nonzero(np.arange(self.k) < self.held[:, None])
        return q, self.n[q, place], self.score[q, place], self.sim[q, place]


def _same(ids: np.ndarray, cid: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` with ``ids[i] == cid[j]``; ``order`` sorts ``cid``."""
    by = cid[order]
    first, last = np.searchsorted(by, ids, "left"), np.searchsorted(by, ids, "right")
    i = np.repeat(np.arange(len(ids)), last - first)
    return i, order[first[i] + np.arange(len(i)) - np.searchsorted(i, i, "left")]


def _scan(kind: str, k: int, apart: bool, balls: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Kernel over ``(qb, stripe, kind, ord, cb, id, vec, pay, bound, tie)``
    sorted by cell: queries first, then candidate blocks, nearest first."""
    metric = METRICS[kind]
    centres, radii, owner = balls

    def meet(best: Best, ids, x, rough, pay, cb, cid, cx, cpay) -> None:
        mine = slice(*np.searchsorted(owner, [cb, cb + 1]))
        crough, near, order = metric.rough(cx), metric.error(x, cx), np.argsort(cid, kind="stable")
        for s in range(0, len(ids), TILE):
            rows = np.arange(s, min(len(ids), s + TILE))
            reach = metric.distance(best.bound[rows] - metric.near) if kind == "cosine" else metric.distance(best.bound[rows])
            away = (metric.distance(metric.scores(x[rows], centres[mine])) - radii[mine]).min(1)
            rows = rows[(away <= reach + metric.slack) | np.isinf(best.bound[rows])]
            if not len(rows):
                continue
            score = metric.scores(rough[rows], crough)
            if apart:
                score[_same(ids[rows], cid, order)] = -np.inf
            least = np.finfo(score.dtype).min          # what is left out scores less
            cut = np.maximum(best.bound[rows] - near, least)
            passed = score >= cut.astype(score.dtype)[:, None]
            if len(cid) > k:                       # only queries that many candidates pass need their k-th score
                many = np.flatnonzero(np.count_nonzero(passed, axis=1) > 4 * k)
                if len(many):
                    kth = (score[many].max(1) if k == 1 else np.partition(score[many], len(cid) - k, axis=1)[:, len(cid) - k]).astype(float)
                    cut[many] = np.maximum(cut[many], np.maximum(kth - near, least))
                    passed[many] = score[many] >= cut[many].astype(score.dtype)[:, None]
            i, j = np.divmod(np.flatnonzero(passed), len(cid))
            for p in range(0, len(i), 1 << 16):
                a, b = rows[i[p:p + (1 << 16)]], j[p:p + (1 << 16)]
                fixed = metric.exact(x[a], cx[b])
                best.add(a, cid[b], fixed, None if pay is None else lambda on, a=a, b=b: (pay[a[on]] * cpay[b[on]]).sum(axis=1))

    def flush(best: Best | None, ids) -> Iterator[pa.RecordBatch]:
        if best is not None and best.held.any():
            q, n, score, sim = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(n), pa.array(score), pa.array(sim)], names=["q", "n", "score", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best, ids, x, rough, pay = None, [], None, None, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2, 4)], 1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(at)]):
                if cell is None or (at[s, :2] != cell).any():
                    yield from flush(best, ids)
                    cell, held, best = at[s, :2], [], None
                part = batch.slice(s, e - s)
                rows = rows_of(part.column(6), metric.item)
                extra = None if part.column(7).null_count else rows_of(part.column(7), "<f8")
                if at[s, 2] == 0:
                    bound = part.column(8).to_numpy(zero_copy_only=False).astype(float)
                    held.append((part.column(5).to_numpy(), rows, extra, np.where(np.isnan(bound), -np.inf, bound),
                                 part.column(9).fill_null(-1).to_numpy()))
                    continue
                if best is None:
                    if not held:
                        continue
                    ids, x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    pay = None if held[0][2] is None else np.concatenate([h[2] for h in held])
                    rough = metric.rough(x)
                    best, held = Best(np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]), k), []
                meet(best, ids, x, rough, pay, at[s, 3], part.column(5).to_numpy(), rows, extra)
        yield from flush(best, ids)

    return run


def _nearest_block(kind: str, balls: tuple[np.ndarray, np.ndarray, np.ndarray]):
    metric = METRICS[kind]
    centres, _, owner = balls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = metric.scores(rows_of(batch.column(1), metric.item), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(owner[score.argmax(1)])], names=["qb", "cb"])
    return run


def _needed(kind: str, balls: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """``(qb, cb, ord)`` of the blocks a batch of queries needs."""
    metric = METRICS[kind]
    centres, radii, owner = balls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            qb, x = batch.column(0).to_numpy(), rows_of(batch.column(1), metric.item)
            bound = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            bound = np.where(np.isnan(bound), -np.inf, bound)
            found: dict = {}
            for s in range(0, len(x), TILE):
                away = metric.distance(metric.scores(x[s:s + TILE], centres))
                least = bound[s:s + TILE]
                reach = np.where(np.isinf(least), np.inf, metric.distance(np.maximum(least, -1e300) - metric.near))
                away[~(away - radii[None, :] <= reach[:, None] + metric.slack)] = np.inf
                for a in np.unique(qb[s:s + TILE]).tolist():
                    nearest = away[qb[s:s + TILE] == a].min(0)
                    found[a] = np.minimum(found[a], nearest) if a in found else nearest
            yield from (out(a, nearest) for a, nearest in found.items())

    def out(a: int, nearest: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(owner, prepend=-1))          # the balls of a block follow each other
        d = np.minimum.reduceat(nearest, first)
        on = np.isfinite(d)
        return pa.RecordBatch.from_arrays([pa.array(np.full(on.sum(), a, np.int64)), pa.array(owner[first][on]), pa.array(d[on])],
                                          names=["qb", "cb", "ord"])

    return run


def _size(n: int, width: int, block_rows: int, min_blocks: int) -> int:
    rows = min(block_rows, max(1, BLOCK_BYTES // max(1, width)), max(256, -(-n // CELLS)))
    return max(1, -(-n // max(min_blocks, -(-n // rows))))


def topk(queries: DataFrame, candidates: DataFrame, k: int, kind: str, self_mode: str = "first",
         block_rows: int = BLOCK_ROWS, min_blocks: int = 1, stripe: int = STRIPE) -> DataFrame:
    """``(q, n, score, sim, rnk)``: the best ``k`` candidates of every query.

    Inputs are ``(id, x)`` with ``x`` a unit vector (``cosine``) or 32-bit
    signature words (``hamming``), and optionally ``v``, a vector that travels
    with the signature: ``sim`` is then the dot product of the two vectors of a
    kept pair (without ``v``, the score).  ``self_mode``: ``first`` puts the
    query itself at rank 1, ``exclude`` drops it, ``none`` ranks it like any
    other.  Ties go to the smaller id.  Pass one table for both sides of a self join."""
    metric, same = METRICS[kind], queries is candidates
    seen = {"n": F.count(F.lit(1)), "width": F.max(F.length("vec"))}
    crows = checkpoint(packed(candidates, kind), observe=seen)
    qseen = dict(seen) if same else {"n": F.count(F.lit(1))}
    qrows = crows if same else checkpoint(packed(queries, kind), observe=qseen)
    spark = crows.sparkSession
    if not seen["n"] or not qseen["n"]:
        return spark.createDataFrame([], OUT + ", rnk int")
    size = max(_size(seen["n"], seen["width"], block_rows, min_blocks), -(-seen["n"] // MAX_BLOCKS))
    blocks = -(-seen["n"] // size)
    marks = pivots(crows, kind, min(PIVOTS, 4 * blocks))
    cands = placed(crows, kind, marks, size)
    asked, qsize = (cands, size) if same else (None, _size(qseen["n"], seen["width"], block_rows, min_blocks))
    if asked is None or size > block_rows:
        qsize = min(qsize, block_rows)
        asked = placed(qrows, kind, marks, qsize)
    qblocks = -(-qseen["n"] // qsize)
    # in a large self join some blocks of queries are held together, so that each candidate is sent that many times less
    joined = max(1, min(JOINED, block_rows * JOINED // qsize, qblocks // CELLS)) if asked is cands else 1
    qblocks = -(-qblocks // joined)
    about = sorted(summaries(cands, kind).collect(), key=lambda r: (r.block, r.leaf))       # MAX_BLOCKS + PIVOTS rows at most
    balls = (rows_of([bytes(r.centre) for r in about], metric.item), np.array([r.radius for r in about]),
             np.array([r.block for r in about], np.int64))
    apart = self_mode != "none"
    unknown = asked.select(F.floor(F.col("block") / joined).cast("long").alias("qb"), "id", "vec", "pay", F.lit(None).cast("double").alias("bound"),
                           F.lit(None).cast("long").alias("tie"))

    def scanned(held: DataFrame, pairs: DataFrame, cells: int) -> DataFrame:
        met = cands.withColumnRenamed("block", "cb").join(pairs, "cb")
        where = ["qb", "stripe", "kind", "ord", "cb"]

        def line(df: DataFrame, kind_: int, order: Column, block: Column) -> DataFrame:
            return df.select("qb", "stripe", F.lit(kind_).cast("long").alias("kind"), order.alias("ord"), block.alias("cb"), "id", "vec", "pay",
                             "bound", "tie")
        none = met.withColumn("bound", F.lit(None).cast("double")).withColumn("tie", F.lit(None).cast("long"))
        rows = line(held, 0, F.lit(0.0), F.lit(-1).cast("long")).unionByName(line(none, 1, F.col("ord"), F.col("cb")))
        # more partitions than cells: fewer cells meet in one task by their hash
        rows = rows.repartition(max(1, min(SPREAD * cells, 1 << 14)), "qb", "stripe").sortWithinPartitions(*where)
        return rows.mapInArrow(_scan(kind, k, apart, balls), OUT)

    own = spark.range(blocks).select(F.floor(F.col("id") / joined).cast("long").alias("qb"), F.col("id").alias("cb")) if asked is cands else checkpoint(
        summaries(asked, kind).select("block", "centre").mapInArrow(_nearest_block(kind, balls), "qb long, cb long")
        .groupBy("qb").agg(F.min("cb").alias("cb")))
    own = own.select("qb", "cb", F.lit(0).cast("long").alias("stripe"), F.lit(0.0).alias("ord"))
    first = checkpoint(scanned(unknown.withColumn("stripe", F.lit(0).cast("long")), own, qblocks))
    last = first.groupBy("q").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("bound"),
                                  F.max_by("n", F.struct(-F.col("score"), "n")).alias("tie")).where(F.col("_n") == k)
    known = checkpoint(unknown.drop("bound", "tie").join(last.select(F.col("q").alias("id"), "bound", "tie"), "id", "left"))
    order = Window.partitionBy("qb").orderBy("ord", "cb")
    pairs = known.select("qb", "vec", "bound").mapInArrow(_needed(kind, balls), "qb long, cb long, ord double") \
        .groupBy("qb", "cb").agg(F.min("ord").alias("ord")).join(own.select("qb", "cb"), ["qb", "cb"], "left_anti") \
        .withColumn("stripe", F.floor((F.row_number().over(order) - 1) * size / stripe).cast("long"))
    pairs = checkpoint(pairs, observe=(needed := {"n": F.count(F.lit(1)), "top": F.max("stripe")}))
    held = known.join(pairs.select("qb", "stripe").distinct(), "qb")
    found = first
    if needed["n"]:
        found = found.unionByName(scanned(held, pairs, qblocks * (needed["top"] + 1)))
    if self_mode == "first":
        found = found.unionByName(_selves(asked, cands, same, kind))
    ranks = [F.col("score").desc(), F.col("n").asc()]
    if self_mode == "first":
        ranks.insert(0, (F.col("q") == F.col("n")).desc())
    return found.withColumn("rnk", F.row_number().over(Window.partitionBy("q").orderBy(*ranks))).where(F.col("rnk") <= k)


def _selves(asked: DataFrame, cands: DataFrame, same: bool, kind: str) -> DataFrame:
    """A row for every query that is among the candidates."""
    metric = METRICS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = rows_of(batch.column(1), metric.item), rows_of(batch.column(3), metric.item)
            score = metric.exact(a, b)
            sim = score if batch.column(2).null_count else \
                (rows_of(batch.column(2), "<f8") * rows_of(batch.column(4), "<f8")).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(0), pa.array(score), pa.array(sim)],
                                             names=["q", "n", "score", "sim"])

    own = asked.select("id", "vec", "pay")
    both = own.select("*", F.col("vec").alias("cvec"), F.col("pay").alias("cpay")) if same else \
        own.join(cands.select("id", F.col("vec").alias("cvec"), F.col("pay").alias("cpay")), "id")
    return both.select("id", "vec", "pay", "cvec", "cpay").mapInArrow(run, OUT)
