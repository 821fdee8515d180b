"""Operator 13: vectors as codes of eight codebook indexes, learnt by rounds of
assignment and averaging, each assignment by Orchard's search.

Components become whole numbers ``floor(scale * x)``, so every distance, sum
and average is exact and the order of summation plays no part.  The vectors are
written once, packed.  A round reads them, finds every part's nearest entry and
keeps one sum per entry in each task; only those sums (16 vectors) are
shuffled, and only the codebooks reach the driver.

Orchard's search: for every entry the other entries are listed by distance.  A
part starts at an entry and walks its list; an entry that is nearer (or as near
with a lower index) takes over, and the walk goes on at the start of its list.
Entries met before are marked and not measured again.  The walk ends where the
next entry lies beyond twice the current distance: by the triangle inequality
it and all after it are farther than the current one.

Defined results: rows whose vector is null or holds null or non-finite
components are left out; rows repeated with one id, or with a null id, are
separate rows (null ids order last, equal ids by their components); vectors
shorter than the longest, or not divisible by the number of parts, end in
zeros; with fewer rows than entries there are fewer entries; an empty vector is
all zeros; extra columns are ignored; an empty table gives no rows.  Components
whose scaled value or whose squared distance leaves 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint
from topicspark.llm.vecio import matrix, quantised, widest

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    diff = points - entries
    return (diff * diff).sum(1)


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry the indexes of the others by distance, and the squared distances."""
    k = len(entries)
    near = np.zeros((k, max(k - 1, 0)), np.int64)
    gap = np.zeros((k, max(k - 1, 0)), entries.dtype)
    for i in range(k):
        d = _squares(entries, entries[i])
        order = np.array([j for j in sorted(range(k), key=lambda j: (d[j], j)) if j != i], np.int64)
        near[i], gap[i] = order, d[order]
    return near, gap


def orchard(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, squared distance)`` of every point's nearest entry, ties to the
    lower index.  All points take one step of their walk at a time."""
    n, k = len(points), len(entries)
    near, gap = neighbour_lists(entries)
    cur, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
    dist = _squares(points, entries[0])
    marked = np.zeros((n, k), bool)
    marked[:, 0] = True
    walking = np.arange(n)
    while True:
        walking = walking[at[walking] < k - 1]
        walking = walking[gap[cur[walking], at[walking]] <= 4 * dist[walking]]     # beyond twice the distance: done
        if not len(walking):
            return cur, dist
        entry = near[cur[walking], at[walking]]
        at[walking] += 1
        fresh = ~marked[walking, entry]
        row, entry = walking[fresh], entry[fresh]
        marked[row, entry] = True
        d = _squares(points[row], entries[entry])
        better = (d < dist[row]) | ((d == dist[row]) & (entry < cur[row]))
        row, entry = row[better], entry[better]
        cur[row], dist[row], at[row] = entry, d[better], 0                          # jump to the nearer entry's list


def _assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and squared distances ``(rows, parts)``; plain Python numbers
    where a sum of squares could leave 64 bits."""
    width = x.shape[1] // len(books)
    top = max(widest(x), *(widest(b) for b in books))
    kind = np.int64 if 4 * top * top * max(width, 1) < 1 << 60 else object
    found = [orchard(x[:, p * width:(p + 1) * width].astype(kind), b.astype(kind)) for p, b in enumerate(books)]
    return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)


def _round(packed: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one assignment of all rows."""
    parts, step = len(books), width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros((len(b), step), object) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0), width)
            code, _ = _assign(x, books)
            small = widest(x) * len(x) < 1 << 62
            for p in range(parts):
                for e in np.unique(code[:, p]):
                    rows = x[code[:, p] == e, p * step:(p + 1) * step]
                    count[p][e] += len(rows)
                    total[p][e] += (rows if small else rows.astype(object)).sum(0).astype(object)
        found = [(p, e) for p in range(parts) for e in np.flatnonzero(count[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()),
             pa.array([count[p][e] for p, e in found], pa.int64()),
             pa.array([[str(v) for v in total[p][e]] for p, e in found], pa.list_(pa.string()))],
            names=["part", "entry", "n", "total"])

    sums = packed.select("vec").mapInArrow(run, "part int, entry int, n bigint, total array<string>")
    whole = sums.select("part", "entry", "n", F.posexplode("total").alias("pos", "value")).groupBy("part", "entry", "pos") \
        .agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    new = [b.copy() for b in books]
    for r in whole.collect():                                                       # entries x components, no more
        new[r.part][r.entry, r.pos] = int(r.value) // r.n
    return new


def learn(packed: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of ``packed (id, vec)``, one array ``(entries, width / parts)`` per part."""
    first = packed.orderBy(F.col("id").asc_nulls_last(), "vec").select("vec").limit(entries).collect()
    if not first:
        return []
    start = matrix(pa.array([bytes(r.vec) for r in first], pa.binary()), width)
    books = [np.ascontiguousarray(part) for part in np.split(start, parts, 1)]
    for _ in range(rounds):
        books = _round(packed, books, width)
    return books


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(packed: DataFrame, books: list[np.ndarray], width: int, extra: str) -> DataFrame:
    """``(id, <extra>, code, error)``: hex indexes in part order and the summed squared distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, dist = _assign(matrix(batch.column(2), width), books)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(["".join(f"{i:02x}" for i in row) for row in code.tolist()], pa.string()),
                 pa.array([int(d) for d in dist.sum(1)], pa.int64())], names=["id", extra, "code", "error"])

    kinds = dict(packed.dtypes)
    return packed.select("id", extra, "vec").mapInArrow(run, f"id {kinds['id']}, `{extra}` {kinds[extra]}, code string, error bigint")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """``(id, code, error, label_error)`` per kept row, and the codebooks."""
    seen = {"most": F.max("size")}
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    packed = checkpoint(quantised(rows, "vec", scale), observe=seen)
    width = -(-(seen["most"] or 0) // parts) * parts
    books = learn(packed, width, parts, entries, rounds)
    coded = checkpoint(encode(packed, books or [np.zeros((1, 0), np.int64)] * parts, width, "label"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_same")
    # AQE broadcasts the labels' sums while they are few and splits a common label otherwise
    got = coded.join(sums, F.col("label").eqNullSafe(F.col("_same")), "left").select("id", "code", "error", "label_error")
    return got, books
