"""Operator 1: removal of repeated passages on suffix order.

Every byte covered by a string of ``length`` bytes that also starts earlier
(smaller document, or earlier in the same one) goes.  Strings are judged on
the input; they never cross documents.

1. *Copies.*  Of equal texts only the first takes part; the others are
   membership (each of them is wholly repeated if it has ``length`` bytes).
2. *Anchors.*  In each window of ``length`` bytes the smallest hash among its
   20-byte strings is the anchor, so equal windows have equal anchors at equal
   places.  A maximal run of windows with one anchor is a block: their union,
   at most ``2 * length - 20`` bytes.  Anchors are dealt over buckets by hash;
   each bucket keeps those that occur more than once.
3. *Blocks.*  Equal blocks of an anchor form a class.  The text of the first
   block of each class goes to the anchor's bucket.
4. *Interval expansion.*  The blocks of a bucket form one text.  Breadth-first
   backward extension on its Burrows-Wheeler transform derives the common
   prefixes by increasing value and stops at ``length`` (``bwt``): suffixes
   left without a boundary between them share ``length`` bytes.  In each such
   group the earliest occurrence stays and the others are covered; all blocks
   of a class but the first are covered whole, for each of their windows
   belongs to the group of the first one's window.
5. The covered runs of a document are united and cut out.

A bucket holds the distinct surroundings of its anchors, not their copies.

Defined results: a null text counts as empty; rows are ordered by (id, row
key), null ids first; rows equal in id and text count once and get the same
result; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm import textio as T
from topicspark.llm.bwt import long_prefix_groups
from topicspark.llm.common import arrow_rows, checkpoint, fresh, release

LENGTH = 100
GRAM = 20
SLICE = 8 << 20           # bytes of text whose blocks are sent together
STRETCH = 1 << 18         # bytes of text hashed at a time
BUCKET = 1_500_000        # bytes of corpus per bucket of anchors
_LOW = np.iinfo(np.int64).min

_RNG = np.random.default_rng(77)
_FACTOR = _RNG.integers(0, 2 ** 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_FACTOR[7])
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


def blocks(data: np.ndarray, offsets: np.ndarray, length: int):
    """Blocks of the rows: ``(row, start, size, anchor hash, class hash)``;
    starts are relative to the row."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    value = T._BYTE[data]
    h = value
    for j, width in enumerate((1, 2, 4, 8)):                   # 16-byte hashes by doubling
        if width == 4:
            four = h
        h = h[:-width] * _FACTOR[j] + h[width:]
    h = h[:len(four) - 16] * _FACTOR[4] + four[16:]              # 20 bytes: 16 + 4
    h = T.mix64(h)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    width, grams = 1, length - GRAM + 1
    while 2 * width <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < grams:
        low = np.minimum(low[:len(low) - (grams - width)], low[grams - width:])
    # low[p] belongs to the window [p, p + length)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(low)]
    inside = offsets[row + 1] - np.arange(len(low)) >= length
    p = np.flatnonzero(inside)
    if not len(p):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = (low[p] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (row[p[1:]] != row[p[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    start, size = p[first], p[last] - p[first] + length
    anchor = at[first]
    pre = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * _powers(_BASE, n), dtype=np.uint64)))
    body = (pre[start + size] - pre[start]) * _powers(_INVERSE, n)[start]
    kind = T.mix64(body + T.mix64((size * 256 + anchor - start).astype(np.uint64)))
    r = row[start]
    return r, start - offsets[r], size, h[anchor], kind


def _bucket(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Buckets of anchors; mixed again, for a smallest hash is a small number."""
    return ((T.mix64(anchor + _FACTOR[6]) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def find_blocks(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Blocks with a repeated anchor.  Rows ``(bucket, _rk, head, body)``: with
    ``_rk`` the blocks whose text is wanted from that document (``class,
    start, size``), without it the bucket's occurrences (``class, start, size``
    and the document keys)."""
    def kernel(batch):
        data, off = T.text_bytes(batch.column("_text"))
        order = batch.column("_id").fill_null(_LOW).to_numpy()
        rk = batch.column("_rk").to_numpy()
        for i, j in T.slices(off, SLICE):
            d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            rows, starts, sizes, anchor, kind = _all_blocks(d, o, length)
            bucket = _bucket(anchor, buckets)
            by = np.argsort(bucket, kind="stable")
            bucket = bucket[by]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(by) else []
            out = {"bucket": bucket[cut] if len(by) else [], "keys": [], "doc": [], "at": [], "hash": []}
            for a, z in zip(cut, np.append(cut[1:], len(by)) if len(by) else []):
                pick = by[a:z]
                used, local = np.unique(rows[pick], return_inverse=True)
                out["keys"].append(np.stack([order[i + used], rk[i + used]], 1).astype("<i8").tobytes())
                out["doc"].append(local.astype("<i4").tobytes())
                out["at"].append(np.stack([starts[pick], sizes[pick]], 1).astype("<u4").tobytes())
                out["hash"].append(np.stack([anchor[pick], kind[pick]], 1).astype("<u8").tobytes())
            yield out

    def match(key, part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in part["keys"]]
        base = np.cumsum([0] + [len(k) for k in keys])
        keys = np.concatenate(keys)
        doc = np.concatenate([np.frombuffer(x, "<i4") + b for x, b in zip(part["doc"], base)])
        at = np.concatenate([np.frombuffer(x, "<u4").reshape(-1, 2) for x in part["at"]]).astype(np.int64)
        hashes = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in part["hash"]])
        uniq, same = np.unique(hashes[:, 0], return_inverse=True)
        keep = np.flatnonzero(np.bincount(same, minlength=len(uniq))[same] > 1)
        doc, at, hashes = doc[keep], at[keep], hashes[keep]
        by = np.lexsort((at[:, 0], keys[doc, 1], keys[doc, 0], hashes[:, 1], hashes[:, 0]))
        doc, at, hashes = doc[by], at[by], hashes[by]
        head = np.append(True, (hashes[1:] != hashes[:-1]).any(1)) if len(by) else np.zeros(0, bool)
        cls = np.cumsum(head) - 1
        rows = [(int(key[0]), None, keys[doc].astype("<i8").tobytes(),
                 np.column_stack([cls, at]).astype("<i8").tobytes())] if len(by) else []
        first = np.flatnonzero(head)
        order = first[np.argsort(keys[doc[first], 1], kind="stable")]
        owner = keys[doc[order], 1]
        cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        for a, z in zip(cut, np.append(cut[1:], len(owner)) if len(owner) else []):
            w = order[a:z]
            rows.append((int(key[0]), int(owner[a]), b"", np.column_stack([cls[w], at[w]]).astype("<i8").tobytes()))
        cols = list(zip(*rows)) if rows else [(), (), (), ()]
        # a nullable integer array: a float column would lose low bits of the keys
        return pd.DataFrame({"bucket": list(cols[0]), "_rk": pd.array(list(cols[1]), dtype="Int64"),
                             "head": list(cols[2]), "body": list(cols[3])})

    sent = arrow_rows(docs.select("_id", "_rk", "_text"), kernel,
                      "bucket int, keys binary, doc binary, at binary, hash binary")
    return sent.groupBy("bucket").applyInPandas(match, "bucket int, _rk bigint, head binary, body binary")


def _all_blocks(d: np.ndarray, o: np.ndarray, length: int) -> tuple:
    """Blocks of the rows, hashed stretch by stretch; a longer row is taken in
    stretches that overlap by ``length - 1`` bytes, so each window is met once."""
    found = []
    for i, j in T.slices(o, STRETCH):
        if o[j] - o[i] <= 2 * STRETCH:
            r, *rest = blocks(d[o[i]:o[j]], o[i:j + 1] - o[i], length)
            found.append((r + i, *rest))
        else:
            for s in range(o[i], o[j] - length + 1, STRETCH):
                e = min(int(o[j]), s + STRETCH + length - 1)
                r, start, *rest = blocks(d[s:e], np.array([0, e - s]), length)
                found.append((r + i, start + (s - o[i]), *rest))
    if not found:
        return blocks(d[:0], np.zeros(1, np.int64), length)
    return tuple(np.concatenate(x) for x in zip(*found))


def covered(found: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """``(_rk, runs)``: covered runs ``(start, end)`` per document and bucket."""
    wanted = (found.where(F.col("_rk").isNotNull())
              .groupBy("_rk").agg(F.collect_list(F.struct("bucket", "body")).alias("want")))
    asked = docs.select("_rk", "_text").join(wanted, "_rk").select("_text", "want")

    def cut(batch):
        data, off = T.text_bytes(batch.column("_text"))
        for i, want in enumerate(batch.column("want").to_pylist()):
            text = data[off[i]:off[i + 1]]
            out = {"bucket": [], "head": [], "body": [], "text": []}
            for w in want:
                place = np.frombuffer(w["body"], "<i8").reshape(-1, 3)
                out["bucket"].append(w["bucket"])
                out["head"].append(b"")
                out["body"].append(place[:, [0, 2]].tobytes())
                out["text"].append(b"".join(text[s:s + z].tobytes() for s, z in place[:, 1:]))
            yield out

    texts = arrow_rows(asked, cut, "bucket int, head binary, body binary, text binary")
    every = texts.unionByName(found.where(F.col("_rk").isNull())
                              .select("bucket", "head", "body", F.lit(None).cast("binary").alias("text")))

    def expand(key, part: pd.DataFrame) -> pd.DataFrame:
        has = part["text"].notna()
        mine = part[~has].iloc[0]
        occ = np.frombuffer(mine["body"], "<i8").reshape(-1, 3)
        keys = np.frombuffer(mine["head"], "<i8").reshape(-1, 2)
        n_cls = int(occ[:, 0].max()) + 1
        first = np.flatnonzero(np.append(True, occ[1:, 0] != occ[:-1, 0]))
        size = occ[first, 2]
        start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]       # place of each class in the text
        text = np.zeros(int((size + 1).sum()), np.uint8)
        for body, raw in zip(part.loc[has, "body"], part.loc[has, "text"]):
            place = np.frombuffer(body, "<i8").reshape(-1, 2)
            raw = np.frombuffer(raw, np.uint8)
            to = np.repeat(start[place[:, 0]], place[:, 1]) + np.arange(len(raw)) \
                - np.repeat(np.cumsum(place[:, 1]) - place[:, 1], place[:, 1])
            text[to] = np.where(raw == 0, 255, raw)   # 0 is the end mark; UTF-8 has no byte 255
        order, group = long_prefix_groups(text, length)
        amount = np.bincount(group)
        pick = amount[group] > 1
        place, group = order[pick], group[pick]
        cls = np.searchsorted(start, place, "right") - 1
        shift = place - start[cls]
        doc = first[cls]
        where = occ[doc, 1] + shift
        by = np.lexsort((where, keys[doc, 1], keys[doc, 0], group))
        later = np.append(False, group[by][1:] == group[by][:-1])[:len(by)]
        hit = place[by][later]
        step = np.zeros(len(text) + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + length, -1)
        on = np.cumsum(step[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate(([False], on, [False])).astype(np.int8)))
        run_from, run_to = edge[::2], edge[1::2]
        c = np.searchsorted(start, run_from, "right") - 1
        move = occ[first[c], 1] - start[c]
        members = np.ones(len(occ), bool)
        members[first] = False
        rk = np.concatenate([keys[first[c], 1], keys[members, 1]])
        a = np.concatenate([run_from + move, occ[members, 1]])
        z = np.concatenate([run_to + move, occ[members, 1] + occ[members, 2]])
        by = np.lexsort((a, rk))
        rk, a, z = rk[by], a[by], z[by]
        cut_ = np.flatnonzero(np.append(True, rk[1:] != rk[:-1])) if len(rk) else np.zeros(0, int)
        return pd.DataFrame({"_rk": rk[cut_], "runs": [
            np.column_stack([a[s:e], z[s:e]]).astype("<i8").tobytes()
            for s, e in zip(cut_, np.append(cut_[1:], len(rk)))]})

    return every.groupBy("bucket").applyInPandas(expand, "_rk bigint, runs binary")


def unite(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a set of runs."""
    by = np.argsort(starts, kind="stable")
    starts, ends = starts[by], np.maximum.accumulate(ends[by])
    new = np.append(True, starts[1:] > ends[:-1])
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:], len(starts)) - 1]


def find(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET, id_col: str = "doc_id",
         text_col: str = "text", runs_col: str = "_runs") -> DataFrame:
    """Every row and column of ``docs`` plus ``runs_col``: the covered runs as
    packed ``(start, end)`` longs in byte places, null where none."""
    row_key = F.xxhash64(F.col(id_col), F.col(text_col))
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), row_key.alias("_rk"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = checkpoint(base.select("_id", "_rk", F.octet_length("_text").cast("bigint").alias("n"),
                                  F.unhex(F.sha2("_text", 256)).alias("same")))
    firsts = rows.groupBy("same").agg(F.min(F.struct("_id", "_rk")).alias("f"))
    copies = checkpoint(rows.join(firsts, "same").where(F.col("f._rk") != F.col("_rk"))
                        .groupBy("_rk").agg(F.max("n").alias("copied")))
    reps = base.where(F.octet_length("_text") >= length)
    again = checkpoint(rows.where(F.col("n") >= length).groupBy("_rk").agg(F.count(F.lit(1)).alias("times"))
                       .where(F.col("times") > 1).select("_rk"))
    if not again.isEmpty():                              # a repeated row takes part once
        reps = reps.join(again, "_rk", "left_anti").unionByName(
            reps.join(again, "_rk", "left_semi").dropDuplicates(["_rk"]))
    reps = reps.join(copies, "_rk", "left_anti")
    total = rows.agg(F.sum("n")).first()[0] or 0
    found = checkpoint(find_blocks(reps, length, max(1, -(-total // bucket))))
    release(docs)
    runs = checkpoint(covered(found, reps, length).groupBy("_rk").agg(F.collect_list("runs").alias("_runs")))
    release(docs)
    whole = F.when(F.col("copied") >= length, F.array(F.lit(b""))).otherwise(F.lit(None).cast("array<binary>"))
    marks = runs.unionByName(copies.where(F.col("copied") >= length).select("_rk", whole.alias("_runs")))
    key = fresh(docs, "_rk")
    marks = marks.select(F.col("_rk").alias(key), F.col("_runs").alias(runs_col))
    return docs.withColumn(key, row_key).join(marks, key, "left").drop(key)


def _runs_of(parts: list | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if parts[0] == b"":                                  # a copy: the whole text
        return np.zeros(1, np.int64), np.array([n])
    both = np.concatenate([np.frombuffer(p, "<i8").reshape(-1, 2) for p in parts])
    return unite(both[:, 0], both[:, 1])


def cut_column(docs: DataFrame, text_col: str = "text", out_col: str = "_cut",
               runs_col: str = "_runs") -> DataFrame:
    """Replace ``runs_col`` by a struct: what stays of the text (as bytes), its
    digest and the removed amounts."""
    kind = ("struct<kept: binary, kept_sha256: string, n_bytes: bigint, n_removed: bigint, "
            "n_spans: bigint, spans: array<bigint>>")

    @F.arrow_udf(kind)
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        data, off = T.text_bytes(texts)
        out = {k: [] for k in ("kept", "kept_sha256", "n_bytes", "n_removed", "n_spans", "spans")}
        for i, parts in enumerate(runs.to_pylist()):
            raw = data[off[i]:off[i + 1]]
            a, z = _runs_of(parts, len(raw))
            if len(a):
                stay = np.ones(len(raw), bool)
                step = np.zeros(len(raw) + 1, np.int8)
                step[a] += 1
                step[z] -= 1
                stay = np.cumsum(step[:-1]) == 0
                kept = raw[stay].tobytes()
            else:
                kept = raw.tobytes()
            out["kept"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["n_bytes"].append(len(raw))
            out["n_removed"].append(len(raw) - len(kept))
            out["n_spans"].append(len(a))
            out["spans"].append(np.column_stack([a, z]).ravel().tolist())
        types = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return docs.withColumn(out_col, cut(F.col(text_col), F.col(runs_col))).drop(runs_col)


def cut_text(docs: DataFrame, text_col: str = "text", chars_col: str | None = None,
             runs_col: str = "_runs") -> DataFrame:
    """Replace the text by what stays of it and drop ``runs_col``.  A character
    that loses a part of its bytes goes; a null text stays null.  ``chars_col``
    names a column to hold the new number of code points."""
    @F.arrow_udf("string")
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        data, off = T.text_bytes(texts)
        out = []
        for i, (parts, known) in enumerate(zip(runs.to_pylist(), texts.is_valid().to_pylist())):
            raw = data[off[i]:off[i + 1]]
            a, z = _runs_of(parts, len(raw))
            keep = np.concatenate(([0], np.column_stack([a, z]).ravel(), [len(raw)])).reshape(-1, 2)
            out.append(b"".join(raw[s:e].tobytes() for s, e in keep).decode("utf-8", "ignore") if known else None)
        return pa.array(out, pa.string())

    got = docs.withColumn(text_col, cut(F.col(text_col), F.col(runs_col))).drop(runs_col)
    return got.withColumn(chars_col, F.length(text_col).cast(dict(docs.dtypes)[chars_col])) if chars_col else got
