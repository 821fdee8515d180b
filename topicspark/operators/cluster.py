"""Clustering of the vocabulary by embedding similarity.

All three procedures of the reference are greedy claiming in a fixed order,
so all run on the rank-peel kernel: sequential (ids in order), seeded (seeds
first, in the given order) and one hierarchical merge round (clusters in
order, each list = itself plus its nearest other cluster above the
threshold).  The hierarchical loop keeps centroids and nearest neighbours
between its rounds and renews those that a merge touched; once a fixed number
of clusters is left, however many points they hold, one task works the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.functions.vector import l2_norm
from topicspark.operators import vectors as V
from topicspark.operators.blockscan import BLOCK_BYTES, BLOCK_ROWS, TILE, Cosine, Hamming, topk
from topicspark.operators.peel import rank_peel
from topicspark.operators.ranking import with_global_index
from topicspark.operators.report import rank_within
from topicspark.session import checkpoint, discard, superseded

MATCHED = 1 << 17         # clusters that one task matches in a round: each has one edge, to its nearest
TAIL = BLOCK_ROWS         # clusters of which the remaining rounds fit in one task: a block of them


def tuned_size(vectors: DataFrame, target: float = 0.9, default: int = 32, n_queries: int = 1000) -> int:
    """The number of bits that the size search finds on these vectors."""
    return V.tuned_bits(V.lsh_tuning(vectors, target, n_queries=n_queries), default)


def neighbor_lists(vectors: DataFrame, k: int, method: str = "exact", cut: float = 0.3,
                   nbits: int | None = 32, seed: int = 42, target: float = 0.9) -> DataFrame:
    """The top-k list of every point as edges ``(u, v)`` (u's own row included).

    ``exact``: cosine top-k, no cut.  ``lsh``: Hamming top-k over ``nbits``
    sign bits (None: as many as the size search finds for ``target``), truncated
    at the first cosine below ``cut`` (the query itself always stays in its list)."""
    if method == "lsh" and nbits is None:
        nbits = tuned_size(vectors, target)
    if method == "exact":
        ranked = V.knn_exact(vectors, k)
    elif method == "lsh":
        ranked = V.topk_threshold(
            V.knn_hamming(V.lsh_signatures(vectors, nbits, seed, keep=True), k).select("q", "n", "rnk", "sim"), cut, "prefix")
    else:
        raise ValueError(f"unknown method {method}")
    return ranked.select(F.col("q").alias("u"), F.col("n").alias("v"))


def sequential_cluster(vectors: DataFrame, cluster_size: int = 50, method: str = "exact",
                       cut: float = 0.3, edges: DataFrame | None = None, **kw) -> DataFrame:
    """``(vec_id, cluster_id)``: lowest unvisited point first, claims the
    unvisited points of its top-``cluster_size`` list.  ``edges``: these lists,
    where the caller has them (written) for several clusterings."""
    if edges is None:
        edges = checkpoint(neighbor_lists(vectors, cluster_size, method, cut, **kw))
    ranks = vectors.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("rnk"))
    out, _ = rank_peel(edges, ranks)
    return out.select(F.col("node").alias("vec_id"), "cluster_id")


def seeded_cluster(vectors: DataFrame, seeds: Sequence[int], cluster_size: int = 50,
                   method: str = "exact", cut: float = 0.3, edges: DataFrame | None = None, **kw) -> DataFrame:
    """Seeds are visited first in the given order (a seed claimed by an
    earlier seed is skipped), then the remaining points by id.  ``edges`` as in
    ``sequential_cluster``."""
    if edges is None:
        edges = checkpoint(neighbor_lists(vectors, cluster_size, method, cut, **kw))
    pos = F.array_position(F.array(*[F.lit(int(s)) for s in seeds]).cast("array<long>"), F.col("vec_id"))
    rnk = F.when(pos > 0, F.lit(-(2 ** 62)) + pos).otherwise(F.col("vec_id"))
    ranks = vectors.select(F.col("vec_id").alias("node"), rnk.alias("rnk"))
    out, _ = rank_peel(edges, ranks)
    return out.select(F.col("node").alias("vec_id"), "cluster_id")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(cluster_id, n, total)`` added up per cluster of a batch; the last
    cluster's sum goes on to the next batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        if rest is not None:
            ids, n, x = (np.concatenate(both) for both in zip(rest, (ids, n, x)))
        order = np.argsort(ids, kind="stable")
        ids, n, x = ids[order], n[order], x[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids, n, x = ids[first], np.add.reduceat(n, first), np.add.reduceat(x, first, axis=0)
        yield _sum_rows(ids[:-1], n[:-1], x[:-1])
        rest = (ids[-1:], n[-1:], x[-1:])
    if rest is not None:
        yield _sum_rows(*rest)


def _sum_rows(ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(ids) + 1) * x.shape[1], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))],
                                      names=["cluster_id", "n", "total"])


def vector_sums(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(cluster_id, n, total)``: number and sum of the clusters' vectors.
    Added up where the rows are first, so a large cluster sends a sum per batch.
    (A column for each component makes generated code too long to be compiled.)"""
    kind, null = dict(members.dtypes)["cluster_id"], F.lit(-(1 << 63)).cast("long")
    schema = "cluster_id long, n long, total array<double>"
    rows = members.join(vectors, "vec_id").select(F.coalesce(F.col("cluster_id").cast("long"), null).alias("cluster_id"),
                                                  F.lit(1).cast("long").alias("n"), F.col("v").cast("array<double>").alias("total"))
    return rows.mapInArrow(_added, schema).repartition("cluster_id").sortWithinPartitions("cluster_id").mapInArrow(_added, schema) \
        .select(F.when(F.col("cluster_id") != null, F.col("cluster_id")).cast(kind).alias("cluster_id"), "n", "total")


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(cluster_id, v)``: mean of the member vectors, scaled to unit
    length (a zero mean has no direction and is left out)."""
    arr = vector_sums(members, vectors).select("cluster_id", F.transform("total", lambda x: x / F.col("n")).alias("v"))
    return (arr.withColumn("_norm", l2_norm(F.col("v"))).where(F.col("_norm") > 0)
            .select("cluster_id", F.transform("v", lambda x: x / F.col("_norm")).alias("v")))


def merge_round(members: DataFrame, vectors: DataFrame, threshold: float, **kw) -> DataFrame:
    """C4: one merge round over clusters numbered 0..m-1.

    In cluster order, a cluster not yet merged takes its nearest other
    cluster when that one is not merged yet and the cosine of the centroids
    is above ``threshold``; otherwise it stays alone.  Returns the members
    with the new cluster numbers (in order of the surviving heads)."""
    cents = centroids(members, vectors).select(F.col("cluster_id").alias("vec_id"), "v")
    nn = V.nearest_other(cents, **kw)
    edges = nn.where(F.col("sim") > threshold).select(F.col("q").alias("u"), F.col("n").alias("v"))
    ids = members.select(F.col("cluster_id").alias("node")).distinct() \
        .select("node", F.col("node").alias("rnk"))
    owners, _ = rank_peel(edges, ids)
    return (members.join(owners.select(F.col("node").alias("cluster_id"),
                                       F.col("cluster_id").alias("_new")), "cluster_id")
            .select("vec_id", F.col("_new").alias("cluster_id")))


def singletons(vectors: DataFrame) -> DataFrame:
    """Every point its own cluster, numbered by position in id order."""
    return with_global_index(vectors.select("vec_id"), [F.col("vec_id").asc()], "cluster_id")


def _xv(cents: DataFrame) -> DataFrame:
    return cents.select(F.col("cluster_id").alias("id"), F.col("v").alias("x"))


def _nearest(queries: DataFrame, candidates: DataFrame, **kw) -> DataFrame:
    """``(q, n, sim)``: each query's nearest other candidate, ties by id."""
    return topk(_xv(queries), _xv(candidates), 1, "cosine", "exclude", **kw).select("q", "n", F.col("score").alias("sim"))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(Cosine.exact(a, b))], names=["q", "n", "sim"])


def _nearest_hashed(cents: DataFrame, nbits: int | None, target: float, **kw) -> DataFrame:
    """``(q, n, sim)``: the Hamming-nearest other centroid and its cosine.  Only
    signatures go through the search; the two centroids meet once per pair found."""
    points = cents.select(F.col("cluster_id").alias("vec_id"), "v")
    bits = tuned_size(points, target) if nbits is None else nbits
    found = V.knn_hamming(V.lsh_signatures(points, bits), 1, "exclude", **kw).select("q", "n")
    x = lambda of, name: cents.select(F.col("cluster_id").cast("long").alias(of), F.col("v").alias(name))
    return found.join(x("n", "b"), "n").join(x("q", "a"), "q").select("q", "n", "a", "b").mapInArrow(_cosines, "q long, n long, sim double")


def _updated(nn: DataFrame, cents: DataFrame, changed: DataFrame, removed: DataFrame, **kw) -> DataFrame:
    """The nearest-neighbour table after a round.  Only the changed clusters,
    and those whose nearest one changed or went, search among all; the others
    compare what they have with the changed clusters.  Where most have to
    search, one search of all is less work and gives the same."""
    gone = changed.unionByName(removed)
    left = nn.join(removed.withColumnRenamed("cluster_id", "q"), "q", "left_anti")
    stale = checkpoint(changed.unionByName(
        left.join(gone.withColumnRenamed("cluster_id", "n"), "n", "left_semi").select(F.col("q").alias("cluster_id"))).distinct(),
        observe=(seen := {"n": F.count(F.lit(1))}))
    if 2 * (seen["n"] or 0) > cents.count():
        return _nearest(cents, cents, **kw)
    kept = checkpoint(left.join(stale.withColumnRenamed("cluster_id", "q"), "q", "left_anti"))
    searched = _nearest(checkpoint(cents.join(stale, "cluster_id", "left_semi")), cents, **kw)
    calm = checkpoint(cents.join(kept.select(F.col("q").alias("cluster_id")), "cluster_id", "left_semi"))
    offered = _nearest(calm, checkpoint(cents.join(changed, "cluster_id", "left_semi")), **kw)
    first = F.struct((-F.col("sim")).alias("far"), "n")
    best = kept.unionByName(offered).groupBy("q").agg(F.min(first).alias("b")) \
        .select("q", F.col("b.n").alias("n"), (-F.col("b.far")).alias("sim"))
    return best.unionByName(searched)


def _nearest_row(x: np.ndarray, sig: np.ndarray | None, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every row its nearest other one (ties: the first) and their cosine,
    -inf where there is none; by Hamming distance where ``sig`` is given.
    Scored as in ``blockscan``: close candidates again in one order of summation."""
    metric, rows = (Cosine, x) if sig is None else (Hamming, sig)
    near, sim = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    for s in range(0, len(x), TILE):
        q = np.arange(s, min(len(x), s + TILE))
        score = metric.scores(rows[q], rows)
        score[~np.isfinite(score) | ~there[None, :] | ~there[q][:, None]] = -np.inf
        score[np.arange(len(q)), q] = -np.inf
        i, j = np.nonzero((score >= score.max(1)[:, None] - metric.near) & (score > -np.inf))
        fixed = np.concatenate([metric.exact(rows[q[i[p:p + (1 << 16)]]], rows[j[p:p + (1 << 16)]])
                                for p in range(0, max(len(i), 1), 1 << 16)])
        order = np.lexsort((j, -fixed, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        near[q[i[first]]] = j[first]
        sim[q[i[first]]] = Cosine.exact(x[q[i[first]]], x[j[first]])
    return near, sim


def _finish(K: int, threshold: float, min_merges: int, hash_above: float, nbits: int | None):
    """All remaining rounds over the sums of the clusters' vectors, in cluster
    order: ``(node, head)``, and a row ``(null, null, before, after)`` per round."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches) or [pd.DataFrame(columns=["cluster_id", "n", "total"])]).sort_values("cluster_id")
        ids, n = got["cluster_id"].to_numpy(np.int64), got["n"].to_numpy(float)
        dim = max((len(v) for v in got["total"]), default=0)
        total = np.array([v if len(v) else np.zeros(dim) for v in got["total"]], float).reshape(len(ids), dim)
        at, head, history = np.arange(len(ids)), np.arange(len(ids)), []
        while len(at) > K:
            mean = total[at] / np.maximum(n[at], 1)[:, None]
            norm = np.sqrt((mean * mean).sum(1))
            there = norm > 0
            x = np.divide(mean, norm[:, None], out=np.zeros_like(mean), where=there[:, None])
            sig = None
            if len(at) > hash_above:
                bits = x @ V.lsh_planes(nbits, dim).T >= 0
                sig = np.packbits(np.hstack([bits, np.zeros((len(x), -nbits % 64), bool)]), axis=1).view("<u8")
            near, sim = _nearest_row(x, sig, there)
            free, into = np.ones(len(at), bool), np.arange(len(at))
            for i in range(len(at)):
                if free[i]:
                    free[i] = False
                    if sim[i] > threshold and free[near[i]]:
                        free[near[i]], into[near[i]] = False, i
            moved = np.flatnonzero(into != np.arange(len(at)))
            total[at[into[moved]]] += total[at[moved]]
            n[at[into[moved]]] += n[at[moved]]
            head[at[moved]] = at[into[moved]]
            history.append((len(at), len(at) - len(moved)))
            at = np.delete(at, moved)
            if len(moved) < min_merges:
                break
        while (head[head] != head).any():
            head = head[head]
        yield pd.DataFrame({"node": pd.array(ids, "Int64"), "head": pd.array(ids[head], "Int64")}).assign(before=None, after=None)
        yield pd.DataFrame(history, columns=["before", "after"], dtype="Int64").assign(node=None, head=None)[["node", "head", "before", "after"]]

    return run, "node long, head long, before long, after long"


def _tail(members: DataFrame, vectors: DataFrame, K: int, threshold: float, min_merges: int, hash_above: float,
          nbits: int | None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The remaining rounds in one task, which gets one row per cluster: the
    sum of its vectors, made by the cluster.  Members and history."""
    sums = members.select("cluster_id").distinct().join(vector_sums(members, vectors), "cluster_id", "left").select(
        "cluster_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.array().cast("array<double>")).alias("total"))
    done = checkpoint(sums.repartition(1).mapInPandas(*_finish(K, threshold, min_merges, hash_above, nbits)))
    rounds = done.where(F.col("node").isNull()).select("before", "after").orderBy(F.col("before").desc()).collect()
    heads = done.where(F.col("node").isNotNull()).select(F.col("node").alias("cluster_id"), "head")
    return (checkpoint(members.join(heads, "cluster_id").select("vec_id", F.col("head").alias("cluster_id"))),
            [(r["before"], r["after"]) for r in rounds])


def hierarchical_cluster(vectors: DataFrame, K: int, threshold: float = 0.5, min_merges: int = 10, method: str = "exact",
                         hash_above: int = 20_000, nbits: int | None = None, target: float = 0.9, tail: int = TAIL,
                         **kw) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Merge rounds until at most ``K`` clusters remain or a round merges
    fewer than ``min_merges`` clusters (``K`` is tested between rounds, so
    the result may drop below it).  Returns the members and the cluster
    count before/after each round.

    A cluster keeps the number of its first point, in whose order clusters are
    visited, until the end; so centroids and nearest neighbours of clusters that
    did not change are kept from round to round, and a round searches for the
    changed ones only.  ``method="lsh"``: rounds of more than ``hash_above``
    clusters take the nearest centroid by Hamming distance over ``nbits`` sign
    bits (None: the size search of each round, at ``target``) and its cosine;
    later ones are exact.

    From ``tail`` clusters on (fewer where a block of vectors holds fewer), the
    rest of the rounds is one task's work on one vector per cluster: that many
    rounds of jobs over a few clusters would take longer than all before.
    """
    if method not in ("exact", "lsh"):
        raise ValueError(f"unknown method {method}")
    vectors = checkpoint(vectors)          # read in every round
    members = checkpoint(singletons(vectors))
    m = members.count()
    cents, nn, history = None, None, []
    width = vectors.select(F.size("v").alias("d")).first()
    tail = min(tail, BLOCK_BYTES // max(1, 8 * width["d"])) if width else tail
    while m > K:
        hashed = method == "lsh" and m > hash_above
        if m <= tail and (nbits is not None or not hashed):
            members, rest = _tail(members, vectors, K, threshold, min_merges, hash_above if hashed else float("inf"), nbits)
            history += rest
            break
        if cents is None:
            cents = checkpoint(centroids(members, vectors))
        last = [nn, members, cents]
        with superseded() as keep:
            if hashed:
                nn, exact = keep(checkpoint(_nearest_hashed(cents, nbits, target, **kw))), False
            elif nn is None or not exact:
                nn, exact = keep(checkpoint(_nearest(cents, cents, **kw))), True
        last.append(nn)
        edges = nn.where(F.col("sim") > threshold).select(F.col("q").alias("u"), F.col("n").alias("v"))
        ids = members.select(F.col("cluster_id").alias("node")).distinct().select("node", F.col("node").alias("rnk"))
        with superseded() as keep:
            owners = keep(checkpoint(rank_peel(edges, ids, MATCHED, 1)[0]))
        heads = owners.groupBy("cluster_id").agg(F.min("node").alias("head"))
        moved = checkpoint(owners.join(heads, "cluster_id").where(F.col("node") != F.col("head")).select("node", "head"))
        merged = moved.count()
        members = checkpoint(members.join(moved.withColumnRenamed("node", "cluster_id"), "cluster_id", "left")
                             .select("vec_id", F.coalesce("head", "cluster_id").alias("cluster_id")))
        history.append((m, m - merged))
        m -= merged
        if merged < min_merges:
            break
        if m > K:
            changed = moved.select(F.col("head").alias("cluster_id")).distinct()
            removed = moved.select(F.col("node").alias("cluster_id"))
            fresh = centroids(members.join(changed, "cluster_id", "left_semi"), vectors)
            cents = checkpoint(cents.join(changed.unionByName(removed), "cluster_id", "left_anti").unionByName(fresh))
            if exact:
                with superseded() as keep:
                    nn = keep(checkpoint(_updated(nn, cents, changed, removed, **kw)))
        discard(owners, moved, *[t for t in last if not any(t is now for now in (nn, members, cents))])
    numbers = with_global_index(members.select("cluster_id").distinct(), [F.col("cluster_id").asc()], "_number")
    return checkpoint(members.join(numbers, "cluster_id").select("vec_id", F.col("_number").alias("cluster_id"))), history


# ------------------------------------------------------------------ C6

def word_cluster(members: DataFrame, words: DataFrame) -> DataFrame:
    """``(ngram, cluster_id)`` through the binding ``words (vec_id, ngram)``."""
    return members.join(words, "vec_id").select("ngram", "cluster_id")


def word_cluster_table(methods: dict[str, DataFrame], words: DataFrame) -> DataFrame:
    """``(ngram, <method>_cluster, ...)``: one column per clustering method,
    null where a method leaves the word out.  Any of the columns can be the
    ``cluster_col`` of the topic operators."""
    out = words.select("vec_id", "ngram")
    for name, members in methods.items():
        out = out.join(members.select("vec_id", F.col("cluster_id").alias(f"{name}_cluster")), "vec_id", "left")
    return out.drop("vec_id")


def cluster_words(word_clusters: DataFrame) -> DataFrame:
    """``(cluster_id, n_words, words)``: the words of a cluster, sorted and
    space-joined.  Meant for clusters of bounded size (C1/C2 clusters hold at
    most ``cluster_size`` words); ``cluster_word_pieces`` has no such limit."""
    return word_clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.array_join(F.array_sort(F.collect_list("ngram")), " ").alias("words"))


def cluster_word_pieces(word_clusters: DataFrame, piece: int = 10_000) -> DataFrame:
    """``(cluster_id, piece, n_words, words)``: the sorted words of a cluster
    in numbered pieces of ``piece`` words; no row or task holds a whole cluster."""
    ranked = rank_within(word_clusters.select("cluster_id", "ngram"), ["cluster_id"], [F.col("ngram").asc()])
    return ranked.groupBy("cluster_id", F.floor((F.col("rnk") - 1) / piece).cast("long").alias("piece")).agg(
        F.count(F.lit(1)).alias("n_words"), F.array_join(F.array_sort(F.collect_list("ngram")), " ").alias("words"))
