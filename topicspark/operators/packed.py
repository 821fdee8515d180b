"""Counts of a cluster packed by documents, for the iterative models.

``(cluster, document, word, x)`` is laid out once: a cluster's documents are
dealt over chunks of about ``target`` counts, and a chunk is one row that holds
its words, its documents and the counts as flat arrays.  An iteration brings
the current value of every word to the chunks that use it (one row per chunk
and word, not per count), works on whole documents inside a task, and sums what
comes back per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.session import checkpoint

TARGET = 1 << 16
KEYS = ["cluster_id", "chunk"]
SENT = 1 << 20            # rows of a small table that are sent to every task, at most
WRITTEN = 1 << 22         # bytes of packed chunks that a task hands on at a time, about


def sent(table: DataFrame, rows: int | None) -> DataFrame:
    """``table``, to be sent to every task where it has at most ``SENT`` rows,
    so the other side of a join with it need not be shuffled."""
    return F.broadcast(table) if (rows or 0) <= SENT else table


def _places(col: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in order (null last), and the place of each row's."""
    coded = col.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), "<i4")
    rank[order] = np.arange(len(order), dtype="<i4")
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def _chunk_row(rows: pa.Table, extra: int) -> list:
    docs, d = _places(rows.column(2))
    words, w = _places(rows.column(3))
    order = np.lexsort((w, d))
    first = np.searchsorted(d[order], np.arange(len(docs)))
    values = [rows.column(c).to_numpy() for c in range(4, 5 + extra)]
    return [rows.column(0)[0].as_py(), rows.column(1)[0].as_py(), words, docs, d[order].tobytes(), w[order].tobytes(),
            values[0].astype("<f8")[order].tobytes(), *(v.astype("<f8")[order[first]].tobytes() for v in values[1:])]


def _chunked(names: list[str]):
    """Rows ``(cluster_id, chunk, document, ngram, x[, m])`` sorted by chunk ->
    a row per chunk.  A task holds one chunk's rows and some packed chunks."""
    extra = len(names) - 7

    def written(made: list[list]) -> pa.RecordBatch:
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(row[i]) for row in made)]), pa.int32()),
                                          pa.concat_arrays([row[i] for row in made])) for i in (2, 3)]
        ids = [pa.array([row[i] for row in made], pa.int64()) for i in (0, 1)]
        blobs = [pa.array([row[i] for row in made], pa.binary()) for i in range(4, len(names))]
        return pa.RecordBatch.from_arrays([*ids, *lists, *blobs], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made, size = None, [], [], 0
        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            cuts = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(at)]):
                if s == e:
                    continue
                if key is not None and (at[s] != key).any():
                    made.append(_chunk_row(pa.Table.from_batches(held), extra))
                    held, size = [], size + sum(len(v) for v in made[-1][4:])
                    if size > WRITTEN or len(made) >= 1 << 10:
                        yield written(made)
                        made, size = [], 0
                key = at[s]
                held.append(batch.slice(s, e - s))
        if held:
            made.append(_chunk_row(pa.Table.from_batches(held), extra))
        if made:
            yield written(made)

    return run




def pack(counts: DataFrame, target: int = TARGET) -> DataFrame:
    """``counts (cluster_id, document, ngram, x)`` -> ``(cluster_id, chunk,
    words, docs, d, w, x)``, sorted by document inside a chunk; a document is
    in one chunk.  Number of chunks: a cluster's counts over ``target``.  A
    column ``m`` (a number per document) is kept as one value per document.
    ``cluster_id`` is a whole number.  The counts are shuffled and sorted once
    and packed in streams."""
    kinds = dict(counts.dtypes)
    extra = ["m"] if "m" in counts.columns else []
    sizes = checkpoint(counts.groupBy("cluster_id").agg(F.ceil(F.count(F.lit(1)) / target).alias("_n")),
                       observe=(seen := {"n": F.count(F.lit(1))}))
    placed = counts.join(sent(sizes, seen["n"]), "cluster_id").select(
        F.col("cluster_id").cast("long").alias("cluster_id"), F.pmod(F.xxhash64("document"), F.col("_n")).cast("long").alias("chunk"),
        "document", "ngram", F.col("x").cast("double").alias("x"), *[F.col(c).cast("double").alias(c) for c in extra])
    names = [*KEYS, "words", "docs", "d", "w", "x", *extra]
    return checkpoint(placed.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(
        _chunked(names), f"cluster_id long, chunk long, words array<string>, docs array<{kinds['document']}>, d binary, w binary, x binary"
        + "".join(f", {c} binary" for c in extra)))


def uses(chunks: DataFrame) -> DataFrame:
    """``(cluster_id, chunk, pos, ngram)``: the words of every chunk."""
    return chunks.select(*KEYS, F.posexplode("words").alias("pos", "ngram"))


def extent(chunks: DataFrame, used: DataFrame) -> DataFrame:
    """``(cluster_id, n_docs, n_used_words)`` of packed counts; a document is in one chunk of its cluster."""
    docs = chunks.groupBy("cluster_id").agg(F.sum(F.size(F.array_compact("docs"))).cast("long").alias("n_docs"))
    return docs.join(used.groupBy("cluster_id").agg(F.countDistinct("ngram").alias("n_used_words")), "cluster_id")


def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and count of every entry of a chunk, by document."""
    return np.frombuffer(row["d"], "<i4"), np.frombuffer(row["w"], "<i4"), np.frombuffer(row["x"], float)


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``group`` (0..n-1)."""
    order = np.argsort(group, kind="stable")
    at = np.searchsorted(group[order], np.arange(n))
    return np.add.reduceat(values[order], at, axis=0)       # every group has an entry
