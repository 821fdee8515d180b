"""Embedding operators: unit vectors, exact and Hamming top-k, LSH signatures,
sampling, index recall and the LSH size search.

Nearest-neighbour search is an all-pairs problem.  It never becomes a cross
join here: ``blockscan`` cuts the rows into blocks of similar ones, skips the
blocks that the triangle inequality rules out, and keeps the top-k per query
inside the tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions.constants import FIRST_TRIAL, MAX_TRIALS
from topicspark.functions.vector import l2_norm
from topicspark.operators.blockscan import TILE, Cosine, Hamming, topk
from topicspark.session import checkpoint

PLANES = 512          # planes drawn at a time
SLAB = 8 * PLANES     # bits of signatures that a scan of sampled queries holds at a time
SENT_QUERIES = 4096   # sampled queries whose vectors are sent to every task, at most
PAIRS = 1 << 23       # distances that such a scan holds
TOGETHER = 4096       # sizes up to this many bits are scored in one scan


# ------------------------------------------------------------------ E1

def unit_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, v array<double>)`` scaled to unit length.

    Zero-length vectors have no direction and are left out; ``zero_vectors``
    reports them."""
    v = F.col(vec_col).cast("array<double>")
    return (df.select(F.col(id_col).alias("vec_id"), v.alias("v"))
            .withColumn("_norm", l2_norm(F.col("v")))
            .where(F.col("_norm") > 0)
            .select("vec_id", F.transform("v", lambda x: x / F.col("_norm")).alias("v")))


def zero_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    return df.where(~(l2_norm(v) > 0)).select(F.col(id_col).alias("vec_id"))


# ------------------------------------------------------------------ E2, E5

def knn_exact(vectors: DataFrame, k: int, self_mode: str = "first", **kw) -> DataFrame:
    """Exact cosine top-k of every unit vector: ``(q, n, rnk, sim)``."""
    x = vectors.select(F.col("vec_id").alias("id"), F.col("v").alias("x"))
    return topk(x, x, k, "cosine", self_mode, **kw).select("q", "n", "rnk", F.col("score").alias("sim"))


def nearest_other(vectors: DataFrame, **kw) -> DataFrame:
    """E5: nearest other point by cosine (self excluded by id, ties by id)."""
    return knn_exact(vectors, 1, "exclude", **kw).select("q", "n", "sim")


# ------------------------------------------------------------------ E3

@lru_cache(maxsize=4096)
def _signs(first: int, last: int, dim: int, seed: int) -> np.ndarray:
    rows = [[hashlib.md5(f"{seed}:{j}:{i}".encode()).digest()[0] < 128 for i in range(dim)] for j in range(first, last)]
    return np.where(np.array(rows, bool).reshape(-1, dim), np.int8(1), np.int8(-1))


def _planes(first: int, last: int, dim: int, seed: int) -> np.ndarray:
    return _signs(first, last, dim, seed).astype(np.float64)


def lsh_planes(nbits: int, dim: int, seed: int = 42) -> np.ndarray:
    """±1 hyperplanes, row j = bit j.  Entry (j, i) is +1 when the first hex
    digit of md5('seed:j:i') is below 8.  Bit j depends on j only, so a
    signature of b bits is the prefix of any longer one."""
    return _planes(0, nbits, dim, seed)


def lsh_signatures(vectors: DataFrame, nbits: int, seed: int = 42, first: int = 0, keep: bool = False) -> DataFrame:
    """``(vec_id, sig array<bigint>)``: bit j = dot(v, plane_j) >= 0,
    packed 32 bits per word (bit j in word j // 32 at position j % 32).

    ``first``: only the words of the bits from there on.  ``keep``: the vector
    stays beside its signature (column ``v``).  The planes are drawn in the
    workers from the seed, some at a time; none travel."""
    if nbits % 32 or first % 32:
        raise ValueError("nbits must be a multiple of 32")
    weights = (1 << np.arange(32, dtype=np.int64))

    def sign_bits(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            V = np.stack(pdf["v"].to_numpy())
            words = []
            for s in range(first, nbits, PLANES):
                planes = _planes(s, min(nbits, s + PLANES), V.shape[1], seed)
                bits = (V @ planes.T >= 0).astype(np.int64).reshape(len(pdf), -1, 32)
                words.append((bits * weights).sum(axis=2))
            out = pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), "sig": list(np.hstack(words))})
            if keep:
                out["v"] = pdf["v"].to_numpy()
            yield out

    return vectors.select("vec_id", "v").mapInPandas(sign_bits, "vec_id long, sig array<long>" + (", v array<double>" if keep else ""))


# ------------------------------------------------------------------ E4, E9

def knn_hamming(signatures: DataFrame, k: int, self_mode: str = "first", **kw) -> DataFrame:
    """Top-k by Hamming distance over signatures (flat scan of codes):
    ``(q, n, rnk, hamming)``; ties by id.  Where ``signatures`` hold the
    vectors too (``v``), ``sim`` is the cosine of each pair, taken where the
    pair is scored."""
    extra = ["v"] if "v" in signatures.columns else []
    x = signatures.select(F.col("vec_id").alias("id"), F.col("sig").alias("x"), *extra)
    return topk(x, x, k, "hamming", self_mode, **kw) \
        .select("q", "n", "rnk", (-F.col("score")).cast("long").alias("hamming"), *(["sim"] if extra else []))


def topk_threshold(ranked: DataFrame, cut: float, mode: str = "prefix") -> DataFrame:
    """Apply the similarity cut to ranked lists ``(q, n, rnk, sim)``.

    ``prefix`` keeps the ranks before the first one whose sim is below the
    cut (the list is truncated there); ``filter`` keeps every row with
    ``sim >= cut``.  The query itself is always kept."""
    if mode == "filter":
        return ranked.where((F.col("sim") >= cut) | (F.col("q") == F.col("n")))
    first_bad = (ranked.where((F.col("sim") < cut) & (F.col("q") != F.col("n")))
                 .groupBy("q").agg(F.min("rnk").alias("_stop")))
    return (ranked.join(first_bad, "q", "left")
            .where(F.col("_stop").isNull() | (F.col("rnk") < F.col("_stop")) | (F.col("q") == F.col("n")))
            .drop("_stop"))


# ------------------------------------------------------------------ E6, E7, E8

def query_sample(vectors: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """``m`` points without replacement, ordered by md5('seed:vec_id').
    With ``m`` larger than the table every point is taken.  The limit is the
    feature; only ``m`` rows ever meet in one task."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")))
    return (vectors.select("vec_id", key.alias("_k")).orderBy("_k", "vec_id").limit(m)
            .select("vec_id"))


class Asked:
    """Sampled queries, sent to every task; a worker keeps the words of their signatures."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.token = ids, x, uuid.uuid4().hex

    def __eq__(self, other) -> bool:
        return self.token == other.token

    def __hash__(self) -> int:
        return hash(self.token)


def _words(x: np.ndarray, first: int, last: int, seed: int) -> np.ndarray:
    """The bits ``first`` to ``last`` of the signatures, 64 to a word."""
    bits = np.zeros((len(x), -(-(last - first) // 64) * 64), bool)
    for s in range(first, last, PLANES):
        e = min(last, s + PLANES)
        bits[:, s - first:e - first] = x @ _planes(s, e, x.shape[1], seed).T >= 0
    return np.packbits(bits, axis=1).view("<u8")


@lru_cache(maxsize=128)
def _asked_words(asked: Asked, first: int, last: int, seed: int) -> np.ndarray:
    return _words(asked.x, first, last, seed)


def _best(score: np.ndarray, ids: np.ndarray, asked: Asked, size: int) -> pa.RecordBatch:
    """Each query's row of highest score, by id among equal ones (``ids`` ascend); its own id is left out."""
    score[asked.ids[:, None] == ids[None, :]] = -np.inf
    at = score.argmax(1)
    far = -score[np.arange(len(at)), at]
    on = np.flatnonzero(np.isfinite(far))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(on), size, np.int64)), pa.array(asked.ids[on]), pa.array(ids[at[on]]), pa.array(far[on])],
                                      names=["nbits", "q", "n", "far"])


def _cosines(asked: Asked, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of the rows that may be nearest to a query, in one order of summation; -inf for the others and its own id."""
    score = Cosine.scores(asked.x, x)
    score[~np.isfinite(score) | (asked.ids[:, None] == ids[None, :])] = -np.inf
    i, j = np.nonzero((score >= score.max(1)[:, None] - Cosine.near) & (score > -np.inf))
    out = np.full(score.shape, -np.inf)
    for p in range(0, len(i), 1 << 16):
        a, b = i[p:p + (1 << 16)], j[p:p + (1 << 16)]
        out[a, b] = Cosine.exact(asked.x[a], x[b])
    return out


def _flat(asked: Asked, sizes: list[int], seed: int):
    """``(nbits, q, n, far)``: the nearest other row of every query among the
    rows of a batch, for each size of signatures; ``[0]``: by cosine."""
    cuts = sorted({*range(0, max(sizes), SLAB), *sizes})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = -(-batch.num_rows * len(asked.ids) // PAIRS)
            rows = -(-batch.num_rows // max(1, parts))
            for part in (batch.slice(s, rows) for s in range(0, batch.num_rows, rows or 1)):
                ids = part.column(0).to_numpy()
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                if 0 in sizes:
                    for s in range(0, len(asked.ids), TILE):
                        mine = Asked(asked.ids[s:s + TILE], asked.x[s:s + TILE])
                        yield _best(_cosines(mine, ids, x), ids, mine, 0)
                    continue
                total = np.zeros((len(asked.ids), len(ids)), np.float64)
                for first, last in zip(cuts, cuts[1:]):
                    own, other = _asked_words(asked, first, last, seed), _words(x, first, last, seed)
                    for s in range(0, len(own), TILE):
                        total[s:s + TILE] += Hamming.scores(own[s:s + TILE], other)
                    if last in sizes:
                        yield _best(total.copy() if last < cuts[-1] else total, ids, asked, last)

    return run


def _hits(approx: DataFrame, exact: DataFrame) -> DataFrame:
    return approx.join(exact.select("q", F.col("n").alias("n_exact")), "q").groupBy("nbits").agg(
        F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum((F.col("n") == F.col("n_exact")).cast("long")), F.lit(0)).alias("hits"))


def index_recall(vectors: DataFrame, nbits_list: list[int], n_queries: int = 1000, seed: int = 42,
                 plane_seed: int = 42, **kw) -> DataFrame:
    """Share of sampled queries whose Hamming-nearest other point equals
    the exact nearest other point, for each signature length:
    ``(nbits, n_queries, hits, accuracy)``.  The exact neighbours are found once."""
    rows = [(nbits, n, hits) for nbits, n, hits in recalls(vectors, sorted(set(nbits_list)), n_queries, seed, plane_seed, **kw) if n]
    return vectors.sparkSession.createDataFrame(rows, "nbits int, n_queries long, hits long") \
        .withColumn("accuracy", F.col("hits") / F.col("n_queries"))


def recalls(vectors: DataFrame, sizes: Iterable[int], n_queries: int = 1000, seed: int = 42, plane_seed: int = 42,
            **kw) -> Iterator[tuple[int, int, int]]:
    """``(nbits, n_queries, hits)`` of each size, worked as it is asked for.

    One search by cosine; then one job per size, and one for all sizes of at
    most ``TOGETHER`` bits.  The sampled vectors go to every task (in groups of
    ``SENT_QUERIES``), which makes the signatures of its rows some words at a
    time and adds up the distances: nothing but each query's best row of a batch
    is shuffled, and no signatures are written."""
    sizes = list(sizes)
    if any(a > b for a, b in zip(sizes, sizes[1:])):
        raise ValueError("sizes must rise")
    if any(nbits % 32 for nbits in sizes):
        raise ValueError("nbits must be a multiple of 32")
    sample = checkpoint(query_sample(vectors, n_queries, seed))
    x = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("x")).where(F.col("id").isNotNull())
    x = checkpoint(x.repartition(4 * x.sparkSession.sparkContext.defaultParallelism))       # the scan is work per row, not bytes
    held = x.join(F.broadcast(sample.select(F.col("vec_id").cast("long").alias("id"))), "id", "left_semi").orderBy("id").collect()
    asked = [Asked(np.array([r["id"] for r in part], np.int64), np.array([r["x"] for r in part], float))
             for part in (held[s:s + SENT_QUERIES] for s in range(0, len(held), SENT_QUERIES))]

    def nearest(of: list[int]) -> DataFrame:
        found = [x.mapInArrow(_flat(group, of, plane_seed), "nbits long, q long, n long, far double") for group in asked]
        for other in found[1:]:
            found[0] = found[0].unionByName(other)
        return found[0].groupBy("nbits", "q").agg(F.min(F.struct("far", "n")).alias("b")).select("nbits", "q", F.col("b.n").alias("n"))

    exact = checkpoint(nearest([0]).drop("nbits")) if asked else None
    small = [nbits for nbits in sizes if nbits <= TOGETHER]
    for of in [*([small] if small else []), *([nbits] for nbits in sizes if nbits > TOGETHER)]:
        got = {r["nbits"]: (r["n_queries"], r["hits"]) for r in _hits(nearest(sorted(set(of))), exact).collect()} if asked else {}
        yield from ((nbits, *got.get(nbits, (0, 0))) for nbits in of)


def lsh_tuning(vectors: DataFrame, target_accuracy: float = 0.9, max_trials: int = MAX_TRIALS,
               n_queries: int = 1000, seed: int = 42, **kw) -> DataFrame:
    """The size grid in search order up to the first cell that reaches the
    target: ``(cell, trial, bits_per_table, n_tables, nbits, accuracy,
    chosen)``.  Accuracy depends on the total bit count alone, so each new size
    is scored once, when the search first meets it; new sizes only rise.
    ``max_trials`` is the only bound.  The driver holds one number per size."""
    scored: dict[int, float] = {}
    grid = [(trial, t, 2 ** trial * 2 ** t) for trial in range(FIRST_TRIAL, max_trials + 1) for t in range(1, trial)]
    found = recalls(vectors, list(dict.fromkeys(nbits for _, _, nbits in grid)), n_queries, seed, **kw)
    rows = []
    for trial, t, nbits in grid:
        if nbits not in scored:
            _, n, hits = next(found)
            scored[nbits] = hits / n if n else 0.0
        hit = scored[nbits] >= target_accuracy
        rows.append((len(rows), trial, 2 ** trial, 2 ** t, nbits, scored[nbits], hit))
        if hit:
            break
    return vectors.sparkSession.createDataFrame(
        rows, "cell int, trial int, bits_per_table int, n_tables int, nbits int, accuracy double, chosen boolean")


def tuned_bits(tuning: DataFrame, default: int = 32) -> int:
    """The chosen size, to be passed on as ``nbits``; ``default`` if no cell
    reached the target."""
    row = tuning.where("chosen").select("nbits").first()
    return int(row[0]) if row else default


def find_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, **kw) -> DataFrame:
    """Top-k of given query points: ``queries (vec_id, v)`` against ``vectors``
    by cosine: ``(q, n, rnk, sim)``.  A query whose id is among the vectors
    comes first in its own list."""
    q = queries.select(F.col("vec_id").alias("id"), F.col("v").alias("x"))
    c = vectors.select(F.col("vec_id").alias("id"), F.col("v").alias("x"))
    return topk(q, c, k, "cosine", "first", **kw).select("q", "n", "rnk", F.col("score").alias("sim"))
