"""Topics inside each word cluster: L1 (F1-F4) and LSA.

Counts stay long ``(cluster_id, document, ngram, cnt)``; clusters are a
grouping key, never a driver loop.  Per-cluster totals are joined back from a
group-by (not a window), so a cluster holding a third of all rows is spread
over tasks like any other.

LSA is a rank-``n_topics`` truncated SVD of every cluster's document-word
matrix at once.  The counts are packed once by documents (``packed``).  A
cluster of few words is solved from the triangular factor of its whole matrix,
reduced over its chunks as a tree.  For the others a block Krylov iteration
(Musco and Musco 2015; the basis of three blocks is that of Knyazev 2001) works
in a basis of that width: a chunk multiplies its documents with the basis rows
of its words inside one task, so no pairs of words or documents are ever formed.
The loop runs until the residuals of every cluster settle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.packed import KEYS, TARGET, extent, pack, sent, sums, unpack, uses
from topicspark.session import checkpoint, discard


# ------------------------------------------------------------------ F1-F4

DIRECT = 512              # words of a cluster whose factor, of at most 2 MB, is formed at once
FAN = 16                  # factors of a cluster that one task stacks
CELLS = 1 << 19           # cells of the dense rows that are factored at a time


def cluster_times(word_clusters: DataFrame) -> DataFrame:
    """``(ngram, cluster_id, _times)`` of ``(ngram, cluster_id)`` rows, each pair
    once; sent to every task where there are at most ``packed.SENT``, so the
    counts that meet them need not be shuffled."""
    pairs = checkpoint(word_clusters.groupBy("ngram", "cluster_id").agg(F.count(F.lit(1)).alias("_times")),
                       observe=(seen := {"n": F.count(F.lit(1))}))
    return sent(pairs, seen["n"])


def cluster_doc_word(counts: DataFrame, word_clusters: DataFrame, cluster_col: str = "cluster_id",
                     doc_col: str = "document", word_col: str = "ngram", count_col: str = "count",
                     distinct: bool = False) -> DataFrame:
    """``(cluster_id, document, ngram, cnt)``: counts of the cluster's
    words, duplicate (document, ngram) rows summed; absent pairs are zeros.
    ``cluster_col`` is any method column of the word-cluster table.
    ``distinct``: the counts hold each (document, ngram) once, as those of
    ``text.clean_word_counts`` do, so only the words are grouped."""
    wc = word_clusters.where(F.col(cluster_col).isNotNull()).select(F.col(word_col).alias("ngram"), F.col(cluster_col).alias("cluster_id"))
    c = counts.select(F.col(doc_col).alias("document"), F.col(word_col).alias("ngram"),
                      F.col(count_col).alias("cnt"))
    if distinct:
        return c.join(cluster_times(wc), "ngram") \
            .select("cluster_id", "document", "ngram", (F.col("cnt") * F.col("_times")).cast("long").alias("cnt"))
    return (c.join(wc, "ngram").groupBy("cluster_id", "document", "ngram")
            .agg(F.sum("cnt").cast("long").alias("cnt")))


def l1_doc_loading(cdw: DataFrame) -> DataFrame:
    """total count of the cluster's words per document."""
    return cdw.groupBy("cluster_id", "document").agg(F.sum("cnt").cast("long").alias("loading"))


def l1_topic_words(cdw: DataFrame) -> DataFrame:
    """each word's share of its cluster's total count."""
    per_word = cdw.groupBy("cluster_id", "ngram").agg(F.sum("cnt").alias("cnt"))
    totals = per_word.groupBy("cluster_id").agg(F.sum("cnt").alias("_total"))
    return (per_word.join(totals, "cluster_id")
            .select("cluster_id", "ngram", "cnt", (F.col("cnt") / F.col("_total")).alias("weight")))


def l1_importance(cdw: DataFrame) -> DataFrame:
    """total count of the cluster (the documented meaning) and the sum of
    the word shares (what the reference returns: always 1)."""
    words = l1_topic_words(cdw)
    return words.groupBy("cluster_id").agg(F.sum("cnt").cast("long").alias("total"),
                                            F.sum("weight").alias("share_sum"))


# ------------------------------------------------------------------ LSA

def _triangle(d: np.ndarray, w: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """A factor R of a chunk's matrix A (documents by ``n`` words) with
    ``R^T R = A^T A``, by orthogonal steps only.  Documents with one entry meet
    in one row per word; the others are factored some rows at a time."""
    single = np.bincount(d)[d] == 1
    size = np.sqrt(np.bincount(w[single], x[single] ** 2, n))
    tri = np.diag(size)[size > 0]
    _, d = np.unique(d[~single], return_inverse=True)
    w, x = w[~single], x[~single]
    step, count = max(n, CELLS // n), d[-1] + 1 if len(d) else 0
    for s in range(0, count, step):
        m = min(step, count - s)
        on = slice(*np.searchsorted(d, [s, s + m]))
        dense = np.bincount((d[on] - s) * n + w[on], x[on], m * n).reshape(m, n)
        tri = np.linalg.qr(np.vstack([tri, dense]), mode="r")
    return tri


def _triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for s in range(0, len(pdf), FAN):
            part = pdf.iloc[s:s + FAN]
            yield pd.DataFrame({"cluster_id": part["cluster_id"], "chunk": part["chunk"], "words": part["words"], "factor": [
                _triangle(*unpack(row), len(row["words"])).tobytes() for _, row in part.iterrows()]})


def _spread(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The words of a cluster's factors in order, and the factor of them all."""
    lists = [np.asarray(words, dtype=object) for words in pdf["words"]]
    words = np.unique(np.concatenate(lists))
    rows = []
    for blob, own in zip(pdf["factor"], lists):
        part = np.frombuffer(blob).reshape(-1, len(own))
        wide = np.zeros((len(part), len(words)))
        wide[:, np.searchsorted(words, own)] = part
        rows.append(wide)
    tri = np.vstack(rows)
    return words, np.linalg.qr(tri, mode="r") if len(tri) > len(words) else tri


def _stack(pdf: pd.DataFrame) -> pd.DataFrame:
    words, tri = _spread(pdf)
    return pd.DataFrame({"cluster_id": pdf["cluster_id"][:1], "chunk": [pdf["chunk"].iloc[0] // FAN], "words": [words.tolist()], "factor": [tri.tobytes()]})


def _solved(n_topics: int):
    """A cluster's singular values and vectors, from the factor of all its words."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words, tri = _spread(pdf)
        _, sigma, vt = np.linalg.svd(tri, full_matrices=False)
        top, weights = np.zeros(n_topics), np.zeros((len(words), n_topics))
        top[:len(sigma)], weights[:, :len(sigma)] = sigma[:n_topics], vt[:n_topics].T
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "words": [words.tolist()], "weights": [list(weights)], "top": [top]})

    return run, "cluster_id long, words array<string>, weights array<array<double>>, top array<double>"


def _direct(chunks: DataFrame, n_topics: int) -> DataFrame:
    """``(cluster_id, words, weights, top)`` of every cluster of ``chunks``: one
    factor per chunk where the chunk is, then a tree of ``FAN`` factors a task."""
    schema = "cluster_id long, chunk long, words array<string>, factor binary"
    factors = checkpoint(chunks.select(*KEYS, "words", "d", "w", "x").mapInPandas(_triangles, schema), observe=(seen := {"last": F.max("chunk")}))
    last = seen["last"] or 0
    while last >= FAN:
        factors = factors.groupBy("cluster_id", F.floor(F.col("chunk") / FAN)).applyInPandas(_stack, schema)
        last //= FAN
    run, schema = _solved(n_topics)
    return checkpoint(factors.groupBy("cluster_id").applyInPandas(run, schema))


def _uniform(cols, j: int, seed: int):
    h = F.xxhash64(*cols, F.lit(j), F.lit(seed))
    return (F.pmod(h, F.lit(1 << 20)).cast("double") / float(1 << 19)) - 1.0


def _products(m: int):
    """Of a chunk and the basis rows ``s0..`` of its words: ``A^T A S`` for its
    words (``t0..``), and the triangular factor of ``A S`` (one row more)."""
    s, t = [f"s{j}" for j in range(m)], [f"t{j}" for j in range(m)]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["cluster_id", "ngram", *t, "factor"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=names)
        row, right = left.iloc[0], right.sort_values("pos")
        d, w, x = unpack(row)
        y = sums(x[:, None] * right[s].to_numpy()[w], d, len(row["docs"]))
        back = sums(x[:, None] * y[d], w, len(row["words"]))
        out = pd.DataFrame(np.vstack([back, np.zeros(m)]), columns=t)
        out["cluster_id"], out["ngram"] = row["cluster_id"], [*right["ngram"], None]
        out["factor"] = [None] * len(back) + [np.linalg.qr(y, mode="r").tobytes()]
        return out[names]

    return run, "cluster_id long, ngram string, " + ", ".join(f"{c} double" for c in t) + ", factor binary"


def _stacked(blobs, m: int) -> np.ndarray:
    return np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, m) for b in blobs]), mode="r")


def _solve(m: int, r: int):
    """Per cluster, from the triangular factor of ``A S`` and the Gram matrix
    of ``S``: the singular values in the space of S, and the matrix that takes
    S to its right singular vectors."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["cluster_id", "sigma", "c"])
        tri = _stacked(left["factor"], m)
        gram = sum(np.frombuffer(g).reshape(m, m) for g in right["g"])
        size = np.sqrt(np.maximum(np.diag(gram), 0))
        inv = np.divide(1.0, size, out=np.zeros(m), where=size > 0)
        lam, vec = np.linalg.eigh(gram * inv[:, None] * inv[None, :])
        keep = lam > 1e-10 * m                                  # the rest is linearly dependent
        flat = inv[:, None] * vec[:, keep] / np.sqrt(lam[keep])
        _, sigma, vt = np.linalg.svd(tri @ flat, full_matrices=False)
        turn = (flat @ vt.T)[:, :r]
        c = np.zeros((m, r))
        c[:, :turn.shape[1]] = turn
        return pd.DataFrame({"cluster_id": left["cluster_id"][:1], "sigma": [np.append(sigma, np.zeros(r))[:r]], "c": [c.ravel()]})

    return run, "cluster_id long, sigma array<double>, c array<double>"


def _next_basis(m: int, r: int):
    """Rows of a word's basis ``s``, its product ``t`` and its cluster's
    ``sigma`` and ``c`` -> the new basis: the singular vectors X, their
    residuals ``A^T A X - X sigma^2``, and the part of X that is not from the
    old X.  One row more per cluster: the Gram matrix of these rows."""
    s, t = [f"s{j}" for j in range(m)], [f"t{j}" for j in range(m)]

    def run(batches):
        key, gram, part = None, np.zeros((m, m)), 0

        def total():
            out = pd.DataFrame(np.zeros((1, m)), columns=s)
            out.insert(0, "cluster_id", key), out.insert(1, "part", part), out.insert(2, "ngram", None)
            out["g"], out["rest"] = [gram.tobytes()], [np.diag(gram)[r:2 * r]]
            return out

        for pdf in batches:
            for cluster, rows in pdf.groupby("cluster_id", sort=True):
                if key is not None and cluster != key:
                    yield total()
                    gram = np.zeros((m, m))
                key, part = cluster, int(rows["part"].iloc[0])
                c, sigma = rows["c"].iloc[0].reshape(m, r), rows["sigma"].iloc[0]
                old = rows[s].to_numpy()
                x = old @ c
                new = np.hstack([x, rows[t].to_numpy() @ c - x * sigma ** 2, old[:, r:] @ c[r:]])[:, :m]
                gram = gram + new.T @ new
                out = pd.DataFrame(new, columns=s)
                out.insert(0, "cluster_id", cluster), out.insert(1, "part", rows["part"].to_numpy()), out.insert(2, "ngram", rows["ngram"].to_numpy())
                out["g"], out["rest"] = None, None
                yield out
        if key is not None:
            yield total()

    return run, "cluster_id long, part long, ngram string, " + ", ".join(f"{c} double" for c in s) + ", g binary, rest array<double>"


def packed_counts(cdw: DataFrame, chunk: int = TARGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chunks of ``cdw``, the words they use, and per cluster how many documents and words."""
    chunks = pack(cdw.select(F.col("cluster_id").cast("long"), "document", "ngram", F.col("cnt").cast("double").alias("x")), chunk)
    used = checkpoint(uses(chunks))
    return chunks, used, checkpoint(extent(chunks, used))


def lsa(cdw: DataFrame, n_topics: int = 2, oversample: int = 10, tol: float = 1e-10,
        seed: int = 42, chunk: int = TARGET, word_part: int = 1 << 14, direct: int | None = None,
        packed: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """F5-F9 for every cluster of ``cdw`` at once.

    Returns ``singular (cluster_id, topic, sigma, converged)``, ``words
    (cluster_id, topic, ngram, weight)``, ``loadings (cluster_id, topic,
    document, loading)`` and ``iterations`` (int).  Topics are numbered from 1.
    Signs: in each topic the word of largest absolute weight is positive (ties:
    the smaller word).  Loadings are ``A v`` (document coordinates times sigma).
    ``packed``: ``packed_counts`` of ``cdw``, where the caller has them.

    Clusters of at most ``direct`` words (four times the width of a basis) are
    solved in one step from the triangular factor of their matrix; it is reduced
    by orthogonal steps, so singular values are not squared and weak topics
    beside a strong one survive.

    The others take a block Krylov iteration: the basis holds the current
    approximate vectors X, their residuals and the last step, and X is solved
    for in their joint space.  The singular values come from the triangular
    factor of ``A S``, reduced over the chunks as a tree as well.  An iteration
    writes three tables: products and factors of the chunks; one small matrix per
    cluster; the new basis with its Gram matrix.

    A cluster is settled when the residual of each topic is at most ``tol``
    times its distance to the other singular values (squared), or at the level
    of rounding.  It leaves the loop when settled, or with ``converged`` false
    when 20 steps bring no smaller residual.
    """
    r = n_topics + oversample
    m = 3 * r
    s = [f"s{j}" for j in range(m)]
    spark = cdw.sparkSession
    chunks, used, sizes = packed or packed_counts(cdw, chunk)
    few = F.col("n_used_words") <= (4 * m if direct is None else direct)
    solved = _direct(chunks.join(F.broadcast(sizes.where(few).select("cluster_id")), "cluster_id", "left_semi"), n_topics)
    top = F.col("top"), F.lit(True).alias("settled")
    finished, it = [(solved.select("cluster_id", F.inline(F.arrays_zip(F.col("words").alias("ngram"), F.col("weights").alias("w")))),
                     solved.select("cluster_id", *top))], 0
    if not sizes.where(~few).isEmpty():
        many = sizes.where(~few).select("cluster_id")
        wide, it = _krylov(chunks.join(many, "cluster_id", "left_semi"), used.join(many, "cluster_id", "left_semi"), r, n_topics, tol, seed, word_part)
        finished += [(rows.where(F.col("ngram").isNotNull()).join(ended.select("cluster_id"), "cluster_id", "left_semi")
                      .select("cluster_id", "ngram", F.array(*s[:n_topics]).alias("w")), ended) for rows, ended in wide]
    done_words = spark.createDataFrame([], "cluster_id long, ngram string, topic int, weight double")
    done_sigma = spark.createDataFrame([], "cluster_id long, topic int, sigma double, converged boolean")
    for rows, ended in finished:
        done_words = done_words.unionByName(rows.select("cluster_id", "ngram", F.posexplode("w").alias("topic", "weight"))
                                            .withColumn("topic", F.col("topic") + 1))
        done_sigma = done_sigma.unionByName(
            ended.select("cluster_id", F.posexplode("top").alias("topic", "sigma"), F.col("settled").alias("converged"))
            .withColumn("topic", F.col("topic") + 1))
    pivot = (done_words.groupBy("cluster_id", "topic")
             .agg(F.min(F.struct((-F.round(F.abs("weight"), 9)).alias("a"), F.col("ngram"), F.col("weight"))).alias("m"))
             .select("cluster_id", "topic", F.when(F.col("m.weight") < 0, -1.0).otherwise(1.0).alias("sgn")))
    V = checkpoint(done_words.join(pivot, ["cluster_id", "topic"])
                   .select("cluster_id", "topic", "ngram", (F.col("weight") * F.col("sgn")).alias("weight")))
    return {"singular": done_sigma, "words": V, "loadings": _loadings(chunks, used, V, n_topics), "iterations": it}


def _krylov(chunks: DataFrame, used: DataFrame, r: int, n_topics: int, tol: float, seed: int,
            word_part: int) -> tuple[list[tuple[DataFrame, DataFrame]], int]:
    """The iteration of ``lsa`` over all clusters of ``chunks``: pairs of a basis
    and the clusters that ended with it, and the number of iterations."""
    m = 3 * r
    s, t = [f"s{j}" for j in range(m)], [f"t{j}" for j in range(m)]
    spark = chunks.sparkSession
    words = used.select("cluster_id", "ngram").distinct()
    sizes = words.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / word_part).alias("_n"))
    words = checkpoint(words.join(sizes, "cluster_id").select("cluster_id", F.pmod(F.xxhash64("ngram"), F.col("_n")).cast("long").alias("part"), "ngram"))

    def formed(rows: DataFrame) -> DataFrame:
        run, schema = _next_basis(m, r)
        return checkpoint(rows.repartition("cluster_id", "part").sortWithinPartitions("cluster_id").mapInPandas(run, schema))

    unit = np.zeros((m, r))
    unit[:r] = np.eye(r)
    start = words.select("*", *[_uniform(["cluster_id", "ngram"], j, seed).alias(c) for j, c in enumerate(s)],
                         *[_uniform(["cluster_id", "ngram"], m + j, seed).alias(c) for j, c in enumerate(t)])
    # random X, "residuals" and last step: every column of the first basis is random
    basis = formed(start.withColumn("c", F.array(*[F.lit(float(v)) for v in (unit + np.eye(m, r, -r) * 0.5).ravel()]))
                   .withColumn("sigma", F.array(*[F.lit(0.5)] * r)))
    going = spark.createDataFrame([], "cluster_id long, best double, stuck int")
    live, it, more = words.select("cluster_id").distinct(), 0, not words.isEmpty()
    finished = []
    while more:
        it += 1
        run, schema = _products(m)
        now = used.join(basis.where(F.col("ngram").isNotNull()).select("cluster_id", "ngram", *s), ["cluster_id", "ngram"])
        made = checkpoint(chunks.join(live, "cluster_id", "left_semi").groupBy(*KEYS).cogroup(now.groupBy(*KEYS)).applyInPandas(run, schema))
        factors = made.where(F.col("ngram").isNull()).select("cluster_id", "factor")
        tree = (factors.withColumn("k", F.pmod(F.xxhash64("factor"), F.lit(64))).groupBy("cluster_id", "k")
                .applyInPandas(lambda p: pd.DataFrame({"cluster_id": p["cluster_id"][:1], "factor": [_stacked(p["factor"], m).tobytes()]}),
                               "cluster_id long, factor binary"))
        grams = basis.where(F.col("ngram").isNull()).join(live, "cluster_id", "left_semi").select("cluster_id", "g")
        run, schema = _solve(m, r)
        small = checkpoint(tree.groupBy("cluster_id").cogroup(grams.groupBy("cluster_id")).applyInPandas(run, schema))
        products = made.where(F.col("ngram").isNotNull()).groupBy("cluster_id", "ngram").agg(*[F.sum(c).alias(c) for c in t])
        old, basis = basis, formed(products.join(basis.where(F.col("ngram").isNotNull()).select("cluster_id", "part", "ngram", *s),
                                                 ["cluster_id", "ngram"]).join(small, "cluster_id"))
        state = checkpoint(_state(basis, small, going, n_topics, tol), observe=(seen := {
            "ended": F.sum(F.col("ends").cast("long")), "going": F.sum((~F.col("ends")).cast("long"))}))
        ended = state.where("ends")
        if seen["ended"]:
            finished.append((basis, ended))
        if all(kept is not old for kept, _ in finished):
            discard(old)
        discard(made, small)
        more = bool(seen["going"])
        going = state.where("not ends").select("cluster_id", "best", "stuck")
        live = going.select("cluster_id")
    return finished, it


def _state(basis: DataFrame, small: DataFrame, going: DataFrame, n_topics: int, tol: float) -> DataFrame:
    """Which clusters end: ``(cluster_id, top, best, stuck, settled, ends)``."""
    rest = (basis.where(F.col("ngram").isNull()).select("cluster_id", F.posexplode("rest").alias("j", "v"))
            .where(F.col("j") < n_topics).groupBy("cluster_id", "j").agg(F.sqrt(F.sum("v")).alias("v"))
            .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("rest")))
    sq = F.transform(F.slice("sigma", 1, n_topics + 1), lambda v: v * v)
    floor = F.col("sq")[0] * 1e-14 + 1e-300
    # distance of each topic's squared singular value to the others', but not below a millionth of it
    gap = F.transform(F.slice("sq", 1, n_topics), lambda a, i: F.greatest(a * 1e-6, F.array_min(F.transform(
        "sq", lambda b, k: F.when(k == i, F.lit(float("inf"))).otherwise(F.abs(a - b))))))
    off = F.aggregate(F.zip_with("rest", "gap", lambda v, g: v / F.greatest(F.lit(tol) * F.least(g, F.col("sq")[0]), floor)),
                      F.lit(0.0), lambda acc, v: F.greatest(acc, v))
    return (small.join(rest, "cluster_id").join(going, "cluster_id", "left")
            .withColumn("sq", sq).withColumn("gap", gap).withColumn("off", off)
            .withColumn("stuck", F.when(F.col("off") < F.coalesce("best", F.lit(float("inf"))), 0)
                        .otherwise(F.coalesce("stuck", F.lit(0)) + 1))
            .withColumn("best", F.least("off", F.coalesce("best", F.lit(float("inf")))))
            .withColumn("settled", F.col("off") <= 1).withColumn("ends", F.col("settled") | (F.col("stuck") >= 20))
            .select("cluster_id", F.slice("sigma", 1, n_topics).alias("top"), "best", "stuck", "settled", "ends"))


def _loadings(chunks: DataFrame, used: DataFrame, V: DataFrame, n_topics: int) -> DataFrame:
    """``(cluster_id, topic, document, loading)``: ``A v`` of every chunk.  A
    chunk gets the vectors of its words as one value."""
    kind = chunks.schema["docs"].dataType.elementType.simpleString()
    cols = [f"v{j}" for j in range(n_topics)]
    wide = V.groupBy("cluster_id", "ngram").agg(*[F.max(F.when(F.col("topic") == j + 1, F.col("weight"))).alias(c) for j, c in enumerate(cols)])
    own = used.join(wide, ["cluster_id", "ngram"]).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("pos", *cols))).alias("v"))
    own = checkpoint(own.select(*KEYS, *[F.col("v")[c].alias(c) for c in cols]), observe=(seen := {"n": F.sum(F.size(cols[0]))}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                d, w, x = unpack({c: row[c].as_py() for c in ("d", "w", "x")})
                v = np.stack([row[c].values.to_numpy() for c in cols], 1)
                docs = row["docs"].values
                y = sums(x[:, None] * v[w], d, len(docs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(y.size, row["cluster_id"].as_py(), np.int64)), pa.array(np.tile(np.arange(1, n_topics + 1, dtype=np.int32), len(y))),
                     docs.take(pa.array(np.repeat(np.arange(len(y)), n_topics))), pa.array(y.ravel())], names=["cluster_id", "topic", "document", "loading"])

    return chunks.join(sent(own, seen["n"]), KEYS).select("cluster_id", "docs", "d", "w", "x", *cols) \
        .mapInArrow(run, f"cluster_id long, topic int, document {kind}, loading double")


def lsa_status(word_clusters: DataFrame, cdw: DataFrame, n_topics: int = 2, min_words: int = 5,
               used: DataFrame | None = None) -> DataFrame:
    """F10 guard as a table: ``(cluster_id, n_words, n_docs, n_used_words, status)``.
    ``too_small``: fewer than ``min_words`` words; ``no_documents``: no
    counts; ``rank_lt_n``: fewer documents or used words than topics.
    ``used``: the clusters' documents and words, where the caller has counted them."""
    sizes = word_clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_words"))
    if used is None:
        used = cdw.groupBy("cluster_id").agg(F.countDistinct("document").alias("n_docs"),
                                             F.countDistinct("ngram").alias("n_used_words"))
    s = sizes.join(used, "cluster_id", "left").fillna(0, ["n_docs", "n_used_words"])
    status = (F.when(F.col("n_words") < min_words, "too_small")
              .when(F.col("n_docs") == 0, "no_documents")
              .when((F.col("n_docs") < n_topics) | (F.col("n_used_words") < n_topics), "rank_lt_n")
              .otherwise("ok"))
    return s.withColumn("status", status)


def lsa_topics(word_clusters: DataFrame, cdw: DataFrame, n_topics: int = 2, min_words: int = 5,
               **kw) -> dict[str, DataFrame]:
    """LSA over the clusters whose status is ``ok``, plus the reports
    R3/R4 (singular values and importances per cluster).  Clusters of at most
    ``DIRECT`` words are solved in one step."""
    kw = {"direct": DIRECT, **kw}
    chunks, used, sizes = packed_counts(cdw, kw.get("chunk", TARGET))
    status = checkpoint(lsa_status(word_clusters, cdw, n_topics, min_words, sizes))
    ok = status.where(F.col("status") == "ok").select("cluster_id")
    res = lsa(cdw.join(ok, "cluster_id", "left_semi"), n_topics,
              packed=tuple(t.join(ok, "cluster_id", "left_semi") for t in (chunks, used, sizes)), **kw)
    imp = (res["loadings"].groupBy("cluster_id", "topic").agg(F.sum(F.abs("loading")).alias("l1"))
           .join(res["singular"], ["cluster_id", "topic"])
           .select("cluster_id", "topic", (F.col("l1") * F.abs("sigma")).alias("importance")))
    res["importance"] = imp
    settled = res["singular"].groupBy("cluster_id").agg(F.min("converged").alias("converged"))
    res["status"] = status.join(settled, "cluster_id", "left")
    return res


def by_topic_columns(df: DataFrame, value: str, names: tuple[str, str]) -> DataFrame:
    """``(cluster_id, <first>, <second>)`` from long (cluster_id, topic, value)."""
    return df.groupBy("cluster_id").agg(
        F.max(F.when(F.col("topic") == 1, F.col(value))).alias(names[0]),
        F.max(F.when(F.col("topic") == 2, F.col(value))).alias(names[1]))
