"""Operator 6: embedding near-duplicates by sorted projection passes.

1. Equal vectors are one class; one vector of each goes on.
2. In each pass every vector gets the signs of 62 random projections as one
   number.  The vectors are sorted by it (lexicographic order of the
   concatenated hash bits) and each is compared with the ``window`` vectors
   before it, in double precision.  Two vectors at the threshold agree in a
   bit with probability ``1 - acos(t) / pi``, and the number of passes is such
   that a pair at the threshold differs in the first ``depth`` bits of all
   passes with probability ``miss``.  ``depth`` is where evenly spread vectors
   are in runs (equal first bits) of a quarter of a window or less.  A task
   keeps a forest of what it found: at most one edge per vector and pass.
3. Where the vectors are not evenly spread, runs are longer than a window.
   Such runs, and those cut by the edge of a partition, are listed with their
   members; the ones whose members are not yet one component are searched
   exactly, in pairs of blocks (all their members together, where that is
   fewer pairs).  So a pair that shares a run in any pass is found.
4. The edges are united into components.
5. Inside a component all pairs count: its classes are cut into blocks of
   ``block`` vectors, and each pair of blocks is multiplied in one task, which
   returns one count per vector.  So the windows bound no vector's links.

Defined results: null vectors, vectors with null or non-finite components and
zero vectors link with nothing; vectors of different lengths are never linked;
equal vectors are linked; very large and very small components neither overflow
nor vanish; rows repeated with one id count as different rows;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint
from topicspark.llm.components import components
from topicspark.operators.ranking import with_global_index

THRESHOLD = 0.95
WINDOW = 64
MISS = 0.002
BLOCK = 1024
BITS = 62


def depth_for(n: int, window: int) -> int:
    """First bits of a code that leave runs of at most a quarter of a window, evenly spread."""
    return min(BITS, max(1, math.ceil(math.log2(max(1, n) / window)) + 2))


def passes_for(depth: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold shared no run with probability ``miss``."""
    together = (1 - math.acos(threshold) / math.pi) ** depth
    return max(4, math.ceil(math.log(miss) / math.log(1 - together)))


def _matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(-1, dim)


def scaled(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Vectors times the power of two that brings their largest component to
    between 1/2 and 1: no square overflows or vanishes, and no digit changes."""
    some = size > 0
    if not some.any():
        return flat
    _, exponent = np.frexp(np.maximum.reduceat(np.abs(flat), start[some]))
    return np.ldexp(flat, -np.repeat(exponent, size[some]))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def project(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """``(pass, dim, code, cid, vec)``: every class once per pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("vec").to_pylist()
            dims = np.array([len(b) // 8 for b in blobs])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _matrix([blobs[i] for i in at], dim)
                vec = pa.array([blobs[i] for i in at], pa.binary())
                cid = batch.column("cid").take(pa.array(at))
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, int(dim)]).standard_normal((dim, BITS))
                    code = ((x @ planes) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), pa.array(np.full(len(at), dim, np.int32)),
                         pa.array(code), cid, vec], names=["pass", "dim", "code", "cid", "vec"])
    return classes.mapInArrow(run, "pass int, dim int, code bigint, cid bigint, vec binary")


def window_links(sorted_rows: DataFrame, window: int, threshold: float, depth: int) -> DataFrame:
    """``(pass, dim, run, a, b)``: a forest of the pairs ``(a, b)`` found in the
    windows of each partition, and with ``b`` null the members ``a`` of the
    runs (equal first ``depth`` bits) that are longer than a window or touch an
    edge of the partition."""
    def listed(key, ids: list) -> pa.RecordBatch:
        cid = np.concatenate(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cid), key[0], np.int32)), pa.array(np.full(len(cid), key[1], np.int32)),
             pa.array(np.full(len(cid), key[2], np.int64)), pa.array(cid), pa.nulls(len(cid), pa.int64())],
            names=["pass", "dim", "run", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple | None = None                       # last rows of the table before
        last, ids_, edge = None, [], True               # the open run, and whether it may begin before the partition
        for batch in batches:
            if not batch.num_rows:
                continue
            run_key = np.stack([batch.column("pass").to_numpy(), batch.column("dim").to_numpy()], 1)
            cid, blobs = batch.column("cid").to_numpy(), batch.column("vec").to_pylist()
            full = np.column_stack([run_key, batch.column("code").to_numpy() >> (BITS - depth)])
            begins = np.flatnonzero(np.append(True, (full[1:] != full[:-1]).any(1)))
            for s, e in zip(begins, np.append(begins[1:], len(cid))):
                if last is not None and (last != full[s]).any():
                    if edge or sum(map(len, ids_)) > window:
                        yield listed(last, ids_)
                    ids_, edge = [], False
                last = full[s]
                ids_.append(cid[s:e])
            cuts = np.append(np.flatnonzero(np.append(True, (run_key[1:] != run_key[:-1]).any(1))), len(cid))
            for s, e in zip(cuts[:-1], cuts[1:]):
                for i in range(s, e, 4096):
                    j = min(e, i + 4096)
                    x, ids = _unit(_matrix(blobs[i:j], run_key[i, 1])), cid[i:j]
                    if tail is not None and (tail[0] == run_key[i]).all():
                        x, ids = np.concatenate([tail[1], x]), np.concatenate([tail[2], ids])
                    a, b = _forest(x, window, threshold)
                    if len(a):
                        none = pa.nulls(len(a), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [none, none, pa.nulls(len(a), pa.int64()), pa.array(ids[a]), pa.array(ids[b])],
                            names=["pass", "dim", "run", "a", "b"])
                    tail = (run_key[i], x[-window:], ids[-window:])
        if last is not None:
            yield listed(last, ids_)
    return sorted_rows.mapInArrow(run, "pass int, dim int, run bigint, a bigint, b bigint")


def _forest(x: np.ndarray, window: int, threshold: float) -> tuple[list[int], list[int]]:
    parent = list(range(len(x)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    for o in range(1, min(window, len(x) - 1) + 1):
        for i in np.flatnonzero(np.einsum("ij,ij->i", x[o:], x[:-o]) >= threshold).tolist():
            a, b = root(i), root(i + o)
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + o)
    return left, right


def block_pairs(members: DataFrame, group: str, block: int) -> DataFrame:
    """The rows of ``members (.., cid, vec)`` once per pair of blocks ``(x, y)``
    of ``block`` rows that their group needs."""
    placed = with_global_index(members, [F.col(group).asc(), F.col("cid").asc()], "idx") \
        .withColumn("blk", F.floor(F.col("idx") / block))
    span = placed.groupBy(group).agg(F.min("blk").alias("lo"), F.max("blk").alias("hi"))
    return (placed.join(span, group)
            .withColumn("other", F.explode(F.sequence("lo", "hi")))
            .select(F.least("blk", "other").alias("x"), F.greatest("blk", "other").alias("y"), "blk",
                    *members.columns))


def _spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins what the pairs ``hit[i, j]`` join, breadth first."""
    todo, fresh = hit.any(1), np.ones(hit.shape[1], bool)
    left, right = [], []
    while todo.any():
        wave = np.flatnonzero(todo)[:1]
        while len(wave):
            todo[wave] = False
            cols = np.flatnonzero(fresh)
            sub = hit[np.ix_(wave, cols)]
            new = sub.any(0)
            reached = cols[new]
            if not len(reached):
                break
            left.append(wave[sub[:, new].argmax(0)])
            right.append(reached)
            fresh[reached] = False
            rows = np.flatnonzero(todo)
            sub = hit[np.ix_(rows, reached)]
            grow = sub.any(1)
            wave = rows[grow]
            if len(wave):
                left.append(wave)
                right.append(reached[sub[grow].argmax(1)])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def run_links(found: DataFrame, classes: DataFrame, comp: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(a, b)``: a forest per pair of blocks of the links between different
    components inside the listed runs of ``found``."""
    listed = (found.where(F.col("b").isNull()).select(F.xxhash64("pass", "dim", "run").alias("run"), "dim", F.col("a").alias("cid"))
              .join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")))
    mixed = (listed.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where(F.col("lo") != F.col("hi")).select("run", "n"))
    listed = checkpoint(listed.join(mixed, "run"))
    pairs = listed.agg(F.sum(F.col("n").cast("double"))).first()[0] or 0.0        # n rows of n pairs per run
    ones = listed.select("dim", "cid", "comp").distinct()
    every = ones.groupBy("dim").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    rows = listed.select("run", "cid", "comp") if pairs <= every else \
        ones.select(F.col("dim").cast("bigint").alias("run"), "cid", "comp")

    def search(key, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in part.groupby(part["vec"].str.len()):
            dim = len(same["vec"].iloc[0]) // 8
            left, right = same[same["blk"] == key[0]], same[same["blk"] == key[1]]
            if not len(left) or not len(right):
                continue
            hit = _unit(_matrix(left["vec"], dim)) @ _unit(_matrix(right["vec"], dim)).T >= threshold
            hit &= left["run"].to_numpy()[:, None] == right["run"].to_numpy()[None, :]
            hit &= left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :]
            i, j = _spanning(hit)
            out.append(pd.DataFrame({"a": left["cid"].to_numpy()[i], "b": right["cid"].to_numpy()[j]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []}).astype("int64")

    sent = block_pairs(rows.join(classes.select("cid", "vec"), "cid").select("run", "cid", "comp", "vec"), "run", block)
    return sent.groupBy("x", "y").applyInPandas(search, "a bigint, b bigint").distinct()


def exact_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``members (comp, cid, copies, vec)`` -> ``(cid, links)``: how many
    vectors of other classes of the component each class is linked to."""
    sent = block_pairs(members, "comp", block)

    def count(key, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in part.groupby(part["vec"].str.len()):
            dim = len(same["vec"].iloc[0]) // 8
            left = same[same["blk"] == key[0]]
            right = same[same["blk"] == key[1]]
            if not len(left) or not len(right):
                continue
            a, b = _unit(_matrix(left["vec"], dim)), _unit(_matrix(right["vec"], dim))
            hit = (a @ b.T >= threshold) & (left["comp"].to_numpy()[:, None] == right["comp"].to_numpy()[None, :])
            hit &= left["cid"].to_numpy()[:, None] != right["cid"].to_numpy()[None, :]
            out.append(pd.DataFrame({"cid": left["cid"], "links": hit @ right["copies"].to_numpy()}))
            if key[0] != key[1]:
                out.append(pd.DataFrame({"cid": right["cid"], "links": hit.T @ left["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"cid": [], "links": []}).astype("int64")

    return (sent.groupBy("x", "y").applyInPandas(count, "cid bigint, links bigint")
            .groupBy("cid").agg(F.sum("links").alias("links")))


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, miss: float = MISS,
          block: int = BLOCK, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, n_links, component_id, kept)`` per row."""
    v = F.col(vec_col).cast("array<double>")
    good = F.coalesce(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0)
                      & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                      & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), good.alias("_good"), v.alias("_v")) \
        .withColumn("cid", F.when(F.col("_good"), F.xxhash64("_v")))

    @F.arrow_udf("binary")
    def pack(col: pa.Array) -> pa.Array:
        size = np.array(col.value_lengths().fill_null(0), np.int64)
        flat = col.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        flat = scaled(flat, ends - size, size)
        return pa.array([flat[e - n:e].astype("<f8").tobytes() for e, n in zip(ends, size)], pa.binary())

    rows = checkpoint(rows.withColumn("vec", F.when(F.col("_good"), pack(F.col("_v")))).select("id", "cid", "vec"))
    classes = checkpoint(rows.where(F.col("cid").isNotNull()).groupBy("cid").agg(
        F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")))
    n = classes.count()
    depth = depth_for(n, window)
    drawn = project(classes.select("cid", "vec"), passes_for(depth, threshold, miss), seed)
    order = ["pass", "dim", "code", "cid"]
    found = checkpoint(window_links(drawn.repartitionByRange(*order).sortWithinPartitions(*order), window, threshold, depth))
    edges = checkpoint(found.where(F.col("b").isNotNull()).select("a", "b").distinct())
    comp = checkpoint(components(edges))
    more = checkpoint(run_links(found, classes, comp, threshold, block))
    if not more.isEmpty():
        comp = checkpoint(components(edges.unionByName(more)))
    members = classes.join(comp.withColumnRenamed("node", "cid"), "cid")
    links = exact_links(members.select("comp", "cid", "copies", "vec"), threshold, block)
    known = classes.select("cid", "low", "copies").join(comp.withColumnRenamed("node", "cid"), "cid", "left") \
        .join(links, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    lows = known.groupBy("comp").agg(F.min("low").alias("component_id"))
    known = known.join(lows, "comp").select(
        "cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (rows.join(known, "cid", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))))
