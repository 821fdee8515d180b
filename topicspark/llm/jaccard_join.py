"""Operator 3: n-gram Jaccard join by vertical partitioning.

The global order of the shingles (their hashes) is cut into fragments.  Each
fragment counts on its own, and the counts are summed:

1. *Classes.*  Documents with the same shingle set are one class; one row of
   each class goes on.  Copies are membership, never pairs.
2. *Repeat counts.*  Every fragment finds which of its shingles occur in more
   than one class and counts them per class; the sum over the fragments says
   how much of a set can overlap with anything.  A set with fewer repeated
   shingles than ``threshold * size`` has no partner, so only the others go
   on.  (The fragments see 32-bit hashes here; a chance meeting only lets a
   set pass.)  A shingle met twice within one batch is sent once.
3. *Stars.*  Every fragment counts, for each of its shingles, one pair per
   occurrence: the class and the most central class of another component that
   holds the shingle.  The partial counts are summed per pair, and each class
   is verified against its best partner.  The number of pairs is linear in the
   occurrences however large a group is.  Rounds go on while they find links.
4. *The rest.*  For all others the prefix filter over the frequency order lists
   candidate pairs of different components, with the length and position
   filters, so no link between different components is lost.
5. *Verification* (3 and 4) counts the overlap of each pair; integers decide.
6. *Links of a document* (where asked for) are counted inside the components,
   two blocks of classes at a time; the pairs are not listed.

Partial counts leave a fragment packed by range of class ids, one row per
fragment and range, and are summed per range.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; fewer
than ``size`` words give the whole sequence as one shingle; null, empty and
blank texts have an empty set and link with nothing; repeated rows are one
class; a null id is never a component's id unless its rows stand alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm import textio as T
from topicspark.llm.common import arrow_rows, checkpoint, fresh
from topicspark.llm.components import components
from topicspark.llm.embedding_dedup import block_pairs

SIZE = 5
PERCENT = 75
SLICE = 4 << 20           # bytes of text worked on at a time: about 20 times as much memory in a task
FRAGMENT = 2_000_000      # shingles per fragment of the repeat count
SEGMENT = 1_500_000       # shingles per fragment of the overlap counts
BLOCK = 512               # classes of a component compared with as many at a time
COLUMNS = 8192            # common shingles multiplied at a time
CLASSES = 100_000         # classes whose partial counts are summed in one task, about
MIN_RANGES = 16           # ranges of class ids at least
ROUNDS = 3                # star rounds at most; the rest is exact whatever they found


def shingle_sets(col: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(first row, sorted distinct shingle hashes of the rows)`` per slice."""
    data, off = T.text_bytes(col)
    for i, j in T.slices(off, SLICE):
        h, row, _, _ = T.words(data[off[i]:off[j]], off[i:j + 1] - off[i])
        s, r = T.shingles(h, row, size)
        cut = np.searchsorted(r, np.arange(j - i + 1))
        yield i, [np.unique(s[a:z]) for a, z in zip(cut[:-1], cut[1:])]


def class_id(hashes: np.ndarray) -> int:
    digest = hashlib.blake2b(hashes.astype("<u8").tobytes(), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def classes(docs: DataFrame, size: int) -> DataFrame:
    """``(_rk, _id, n, cid)`` per row: row key, set size and class id."""
    def kernel(batch):
        for i, sets in shingle_sets(batch.column("_text"), size):
            k = len(sets)
            yield {"_rk": batch.column("_rk").slice(i, k), "_id": batch.column("_id").slice(i, k),
                   "n": np.array([len(s) for s in sets], np.int64), "cid": [class_id(s) for s in sets]}
    return arrow_rows(docs.select("_rk", "_id", "_text"), kernel,
                      f"_rk bigint, _id {dict(docs.dtypes)['_id']}, n bigint, cid bigint")


def _by_fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each hash: equal ranges of the hash order."""
    return ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def _batch_sets(batch, size: int):
    """Distinct sets of a batch, slice by slice: ``(class ids, hashes, owner)``."""
    for _, sets in shingle_sets(batch.column("_text"), size):
        own = {}
        for s in sets:
            if len(s):
                own.setdefault(class_id(s), s)
        if own:
            cids = np.array(list(own), np.int64)
            yield cids, np.concatenate(list(own.values())), np.repeat(
                np.arange(len(own)), [len(s) for s in own.values()])


def _used(frag: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(fragment, first, end)`` of the runs of a sorted array: the fragments that occur."""
    first = np.flatnonzero(np.append(True, frag[1:] != frag[:-1])) if len(frag) else np.zeros(0, np.int64)
    return zip(frag[first].tolist(), first.tolist(), np.append(first[1:], len(frag)).tolist())


def _ranges(cid: np.ndarray, ranges: int, **values: np.ndarray) -> pd.DataFrame:
    """Partial counts of one fragment packed by range of class ids: a row per range, not per class."""
    rng = (cid.view(np.uint64) % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(rng, kind="stable")
    cid, rng = cid[order], rng[order]
    out = {"rng": [], "cid": [], **{k: [] for k in values}}
    for r, a, z in _used(rng):
        out["rng"].append(r)
        out["cid"].append(cid[a:z].astype("<i8").tobytes())
        for k, v in values.items():
            out[k].append(v[order[a:z]].astype("<i8").tobytes())
    return pd.DataFrame(out)


def repeat_counts(reps: DataFrame, size: int, fragments: int, ranges: int) -> DataFrame:
    """``(cid, r)``: how many shingles of each class another class has too.
    The partial counts of a fragment travel packed by range of class ids and
    are summed per range."""
    def kernel(batch):
        for cids, h, owner in _batch_sets(batch, size):
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            new = np.append(True, h[1:] != h[:-1])
            count = np.diff(np.append(np.flatnonzero(new), len(h)))
            twice = np.repeat(count > 1, count)
            known = np.bincount(owner[twice], minlength=len(cids))
            send = new                                     # one entry per distinct hash
            frag, low = _by_fragment(h[send], fragments), (h[send] & np.uint64(0xFFFFFFFF)).astype("<u4")
            who = np.where(twice[send], -1, owner[send]).astype("<i4")
            rows = {"frag": [-1], "h": [b""], "d": [known.astype("<i4").tobytes()], "c": [cids.astype("<i8").tobytes()]}
            for f, a, z in _used(frag):
                used, local = np.unique(who[a:z], return_inverse=True)
                mark = used[0] == -1
                ids = cids[used[1:] if mark else used]
                rows["frag"].append(f)
                rows["h"].append(low[a:z].tobytes())
                rows["d"].append((local - int(mark)).astype("<i2" if len(ids) < 32767 else "<i4").tobytes())
                rows["c"].append(ids.astype("<i8").tobytes())
            yield rows

    def count(key, part: pd.DataFrame) -> pd.DataFrame:
        if int(key[0]) < 0:
            cid = np.concatenate([np.frombuffer(c, "<i8") for c in part["c"]])
            r = np.concatenate([np.frombuffer(d, "<i4") for d in part["d"]])
            return _ranges(cid[r > 0], ranges, r=r[r > 0])
        h = np.concatenate([np.frombuffer(x, "<u4") for x in part["h"]])
        cids = [np.frombuffer(c, "<i8") for c in part["c"]]
        base = np.concatenate(([0], np.cumsum([len(c) for c in cids])))
        local = [np.frombuffer(d, "<i2" if len(d) == len(x) // 2 else "<i4").astype(np.int64)
                 for d, x in zip(part["d"], part["h"])]
        owner = np.concatenate([np.where(d < 0, -1, d + b) for d, b in zip(local, base)])
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size_ = np.diff(np.append(start, len(h)))
        hit = np.repeat((size_ > 1), size_) & (owner >= 0)
        marked = np.repeat(np.minimum.reduceat(owner, start) < 0, size_) & (owner >= 0)
        ids = np.concatenate(cids)
        r = np.bincount(owner[hit | marked], minlength=len(ids))
        return _ranges(ids[r > 0], ranges, r=r[r > 0])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        cid, where = np.unique(np.concatenate([np.frombuffer(c, "<i8") for c in part["cid"]]), return_inverse=True)
        r = np.bincount(where, weights=np.concatenate([np.frombuffer(x, "<i8") for x in part["r"]]))
        return pd.DataFrame({"cid": cid, "r": r.astype(np.int64)})

    sent = arrow_rows(reps.select("_text"), kernel, "frag int, h binary, d binary, c binary")
    sent = sent.withColumn("salt", F.when(F.col("frag") < 0, F.pmod(F.xxhash64("c"), F.lit(64))).otherwise(0))
    return sent.groupBy("frag", "salt").applyInPandas(count, "rng int, cid binary, r binary") \
        .groupBy("rng").applyInPandas(total, "cid bigint, r bigint")


def shared_sets(docs: DataFrame, size: int, fragments: int) -> DataFrame:
    """``(cid, h, f, w)``: of each class of the remaining sets the shingles that
    another of them has, the number of classes of each, and the sum of these
    numbers.  Fragments count, and their results travel packed by range of
    class ids; a range puts its classes together."""
    def kernel(batch):
        for cids, h, owner in _batch_sets(batch, size):
            frag = _by_fragment(h, fragments)
            order = np.lexsort((owner, frag))
            h, owner, frag = h[order], owner[order], frag[order]
            runs = list(_used(frag))
            yield {"frag": np.array([f for f, _, _ in runs], np.int32),
                   "h": [h[a:z].astype("<u8").tobytes() for _, a, z in runs],
                   "c": [cids[owner[a:z]].astype("<i8").tobytes() for _, a, z in runs]}

    def count(key, part: pd.DataFrame) -> pd.DataFrame:
        h = np.concatenate([np.frombuffer(x, "<u8") for x in part["h"]])
        c = np.concatenate([np.frombuffer(x, "<i8") for x in part["c"]])
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        fresh_ = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))     # repeated rows of one class
        h, c = h[fresh_], c[fresh_]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        each = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
        keep = each > 1
        return _ranges(c[keep], fragments, h=h[keep].view(np.int64), f=each[keep])

    def together(part: pd.DataFrame) -> pd.DataFrame:
        c, h, f = (np.concatenate([np.frombuffer(x, "<i8") for x in part[k]]) for k in ("cid", "h", "f"))
        order = np.lexsort((h.view(np.uint64), c))
        c, h, f = c[order], h[order], f[order]
        runs = list(_used(c))
        return pd.DataFrame({"cid": [i for i, _, _ in runs], "h": [h[a:z].tobytes() for _, a, z in runs],
                             "f": [f[a:z].tobytes() for _, a, z in runs], "w": [int(f[a:z].sum()) for _, a, z in runs]})

    sent = arrow_rows(docs.select("_text"), kernel, "frag int, h binary, c binary")
    return sent.groupBy("frag").applyInPandas(count, "rng int, cid binary, h binary, f binary") \
        .groupBy("rng").applyInPandas(together, "cid bigint, h binary, f binary, w bigint")


def stars(sets: DataFrame, comp: DataFrame, fragments: int, ranges: int) -> DataFrame:
    """``(a, b)``: for each class the partner of another component it shares
    most with, among the star centres of its shingles.  A shingle's centre is
    its class of the highest ``p``; classes of the centre's own component take
    the highest class of another one.  Partial counts per fragment travel
    packed by range of class ids and are summed per pair there."""
    rows = (sets.select("cid", "p", "h").join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left")
            .select("cid", "p", F.coalesce("comp", "cid").alias("comp"), "h"))

    def deal(batch):
        raw, off = T.text_bytes(batch.column("h"))
        h = np.frombuffer(raw.tobytes(), "<u8")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(off) // 8)
        cid, p, comp_ = (batch.column(c).to_numpy() for c in ("cid", "p", "comp"))
        frag = _by_fragment(h, fragments)
        order = np.argsort(frag, kind="stable")
        h, owner, frag = h[order], owner[order], frag[order]
        out = {"frag": [], "h": [], "d": [], "cid": [], "p": [], "comp": []}
        for f, a, z in _used(frag):
            who, local = np.unique(owner[a:z], return_inverse=True)
            out["frag"].append(f)
            out["h"].append(h[a:z].tobytes())
            out["d"].append(local.astype("<i4").tobytes())
            for name, v, kind in (("cid", cid, "<i8"), ("p", p, "<f8"), ("comp", comp_, "<i8")):
                out[name].append(v[who].astype(kind).tobytes())
        yield out

    def count(part: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, "<i8") for x in part["cid"]]
        base = np.cumsum([0] + [len(x) for x in each])
        cid, comp_ = np.concatenate(each), np.concatenate([np.frombuffer(x, "<i8") for x in part["comp"]])
        p = np.concatenate([np.frombuffer(x, "<f8") for x in part["p"]])
        h = np.concatenate([np.frombuffer(x, "<u8") for x in part["h"]])
        owner = np.concatenate([np.frombuffer(x, "<i4") + b for x, b in zip(part["d"], base)])
        by = np.lexsort((cid, p))
        cid, comp_ = cid[by], comp_[by]
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))                          # place in the order of (p, cid)
        rank = rank[owner]
        order = np.lexsort((rank, h))
        h, rank = h[order], rank[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        many = np.diff(np.append(start, len(h)))
        top = np.repeat(np.maximum.reduceat(rank, start), many)
        same = comp_[rank] == comp_[top]
        other = np.repeat(np.maximum.reduceat(np.where(same, -1, rank), start), many)
        hub = np.where(same, other, top)
        use = hub >= 0
        pairs, cnt = np.unique(hub[use] * len(cid) + rank[use], return_counts=True)
        return _ranges(cid[pairs % len(cid)], ranges, other=cid[pairs // len(cid)], cnt=cnt)

    def best(part: pd.DataFrame) -> pd.DataFrame:
        cid, other, cnt = (np.concatenate([np.frombuffer(x, "<i8") for x in part[c]]) for c in ("cid", "other", "cnt"))
        order = np.lexsort((other, cid))
        cid, other, cnt = cid[order], other[order], cnt[order]
        start = np.flatnonzero(np.append(True, (cid[1:] != cid[:-1]) | (other[1:] != other[:-1])))
        cid, other, cnt = cid[start], other[start], np.add.reduceat(cnt, start)
        order = np.lexsort((other, cnt, cid))
        last = order[np.append(cid[order][1:] != cid[order][:-1], True)]
        return pd.DataFrame({"a": np.minimum(cid[last], other[last]), "b": np.maximum(cid[last], other[last])})

    sent = arrow_rows(rows, deal, "frag int, h binary, d binary, cid binary, p binary, comp binary")
    return (sent.groupBy("frag").applyInPandas(count, "rng int, cid binary, other binary, cnt binary")
            .groupBy("rng").applyInPandas(best, "a bigint, b bigint").distinct())


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose Jaccard similarity is at least ``percent``."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb"))
    both = pairs.join(left, "a").join(right, "b")

    def kernel(batch):
        n = batch.num_rows
        sides = []
        for name in ("ha", "hb"):
            raw, off = T.text_bytes(batch.column(name))
            sides.append((np.repeat(np.arange(n), np.diff(off) // 8), np.frombuffer(raw.tobytes(), "<u8")))
        row = np.concatenate([s[0] for s in sides])
        h = np.concatenate([s[1] for s in sides])
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
        yield {"a": batch.column("a"), "b": batch.column("b"), "na": batch.column("na"), "nb": batch.column("nb"),
               "o": np.bincount(row[1:][same], minlength=n)}

    total = arrow_rows(both.select("a", "b", "na", "nb", "ha", "hb"), kernel, "a bigint, b bigint, na bigint, nb bigint, o bigint")
    return total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def cross_candidates(sets: DataFrame, comp: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components that the prefix filter over
    the order (frequency, hash) cannot rule out.  Shingles of one class alone
    come first in that order and need no entry."""
    sets = sets.join(comp.select(F.col("node").alias("cid"), "comp"), "cid", "left") \
        .select("cid", "n", F.coalesce("comp", "cid").alias("comp"), "h", "f")

    def prefix(batch):
        out = {"tok": [], "cid": [], "n": [], "comp": [], "pos": []}
        cid, n, comp_ = (batch.column(c).to_numpy() for c in ("cid", "n", "comp"))
        for i, (hs, fs) in enumerate(zip(batch.column("h").to_pylist(), batch.column("f").to_pylist())):
            h, f = np.frombuffer(hs, "<u8"), np.frombuffer(fs, "<i8")
            alone = int(n[i]) - len(h)
            need = -(-percent * int(n[i]) // 100)
            length = int(n[i]) - need + 1 - alone
            if length <= 0:
                continue
            order = np.lexsort((h, f))[:length]
            out["tok"].append(h[order].view(np.int64))
            out["pos"].append(alone + np.arange(len(order)))
            for name, v in (("cid", cid[i]), ("n", n[i]), ("comp", comp_[i])):
                out[name].append(np.full(len(order), v))
        if out["tok"]:
            yield {k: np.concatenate(v).astype(np.int64) for k, v in out.items()}

    def pair(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tok", "comp"], kind="stable")
        tok, comp_, cid, n, pos = (part[c].to_numpy() for c in ("tok", "comp", "cid", "n", "pos"))
        edge = np.append(True, (tok[1:] != tok[:-1]) | (comp_[1:] != comp_[:-1]))
        tok_end = np.searchsorted(tok, tok, "right")
        run = np.flatnonzero(edge)
        run_end = np.repeat(np.append(run[1:], len(tok)), np.diff(np.append(run, len(tok))))
        many = tok_end - run_end                     # entries of the same shingle in later components
        found = np.zeros((0, 2), np.int64)
        step = np.append(np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 1, 1 << 21)), len(tok))
        for s, e in zip(step[:-1], step[1:]):        # bounded slices of the pair list
            k = many[s:e]
            left = np.repeat(np.arange(s, e), k)
            right = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(run_end[s:e], k)
            total = n[left] + n[right]
            need = -(-percent * total // (100 + percent))
            room = 1 + np.minimum(n[left] - pos[left], n[right] - pos[right]) - 1
            ok = (room >= need) & (100 * np.minimum(n[left], n[right]) >= percent * np.maximum(n[left], n[right]))
            a, b = cid[left[ok]], cid[right[ok]]
            found = np.unique(np.concatenate([found, np.stack([np.minimum(a, b), np.maximum(a, b)], 1)]), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    entries = arrow_rows(sets, prefix, "tok bigint, cid bigint, n bigint, comp bigint, pos bigint")
    entries = checkpoint(entries)
    mixed = (entries.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
             .where(F.col("x") != F.col("y")).select("tok"))
    return (entries.join(mixed, "tok", "left_semi")
            .groupBy(F.pmod(F.xxhash64("tok"), F.lit(buckets)).alias("bucket"))
            .applyInPandas(pair, "a bigint, b bigint").distinct())


def link_counts(sets: DataFrame, comp: DataFrame, copies: DataFrame, percent: int, block: int) -> DataFrame:
    """``(cid, links)``: the documents of other classes that each class is
    linked with, counted inside its component in pairs of blocks of ``block``
    classes.  A task multiplies two blocks shingle by shingle and returns one
    number per class; no pairs are listed."""
    sets = sets.join(comp.select(F.col("node").alias("cid"), "comp"), "cid").join(copies, "cid") \
        .select("comp", "cid", "n", "copies", "h")

    def matrix(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(hs, "<u8") for hs in part["h"]]
        return np.repeat(np.arange(len(part)), [len(e) for e in each]), np.concatenate(each)

    def count(key, part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["blk"] == key[0]], part[part["blk"] == key[1]]
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": [], "links": []}).astype("int64")
        (lrow, lh), (rrow, rh) = matrix(left), matrix(right)
        both = np.intersect1d(lh, rh)
        lat, rat = np.searchsorted(both, lh), np.searchsorted(both, rh)
        lin = (lat < len(both)) & (both[np.minimum(lat, len(both) - 1)] == lh) if len(both) else np.zeros(len(lh), bool)
        rin = (rat < len(both)) & (both[np.minimum(rat, len(both) - 1)] == rh) if len(both) else np.zeros(len(rh), bool)
        lrow, lat, rrow, rat = lrow[lin], lat[lin], rrow[rin], rat[rin]
        overlap = np.zeros((len(left), len(right)), np.float32)
        for s in range(0, len(both), COLUMNS):                     # the common shingles some at a time
            a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            on, of = (lat >= s) & (lat < s + COLUMNS), (rat >= s) & (rat < s + COLUMNS)
            a[lrow[on], lat[on] - s] = 1
            b[rrow[of], rat[of] - s] = 1
            overlap += a @ b.T
        o = overlap.astype(np.int64)
        union = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - o
        hit = (100 * o >= percent * union) & (left["comp"].to_numpy()[:, None] == right["comp"].to_numpy()[None, :])
        hit &= left["cid"].to_numpy()[:, None] != right["cid"].to_numpy()[None, :]
        out = [pd.DataFrame({"cid": left["cid"], "links": hit @ right["copies"].to_numpy()})]
        if key[0] != key[1]:
            out.append(pd.DataFrame({"cid": right["cid"], "links": hit.T @ left["copies"].to_numpy()}))
        return pd.concat(out)

    return (block_pairs(sets, "comp", block).groupBy("x", "y").applyInPandas(count, "cid bigint, links bigint")
            .groupBy("cid").agg(F.sum("links").alias("links")))


def spark_empty(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, fragment: int = FRAGMENT,
         segment: int = SEGMENT, id_col: str = "doc_id", text_col: str = "text",
         count_links: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, links, comps)``: rows ``(_rk, _id, n, cid)`` of all documents,
    verified links ``(a, b)`` between classes that span the components, and the
    components ``(node, comp)`` of the linked classes.  With ``count_links``
    the rows have ``n_links``, the other documents linked with each: its copies
    and, counted exactly in blocks, the documents of every linked class."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_rk"))
    rows = checkpoint(classes(base, size))
    sizes_all = rows.groupBy("cid").agg(F.min("_rk").alias("_rk"), F.max("n").alias("n"))
    first = rows.join(sizes_all.select("cid", F.col("_rk").alias("_first")), "cid")
    copies = checkpoint(first.where((F.col("_rk") != F.col("_first")) | (F.col("n") == 0)).select("_rk").distinct())
    reps = base.join(copies, "_rk", "left_anti")
    total = sizes_all.agg(F.sum("n")).first()[0] or 0
    ranges = max(MIN_RANGES, -(-sizes_all.count() // CLASSES))
    counts = repeat_counts(reps, size, max(1, -(-total // fragment)), ranges)
    kept = checkpoint(counts.join(sizes_all, "cid").where(100 * F.col("r") >= percent * F.col("n"))
                      .select("cid", "_rk", "n"))
    left = kept.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-left // segment))
    near = base.select("_rk", "_text").join(kept.select("_rk").distinct(), "_rk", "left_semi")
    # p: the mean frequency of its shingles, so an unedited text of a group comes before its edited copies
    sets = checkpoint(shared_sets(near, size, parts).join(kept.select("cid", "n"), "cid")
                      .select("cid", "n", "h", "f", (F.col("w") / F.col("n")).alias("p")))
    links = spark_empty(docs, "a bigint, b bigint")
    comp = spark_empty(docs, "node bigint, comp bigint")
    for _ in range(ROUNDS):
        new = checkpoint(verify(stars(sets, comp, parts, ranges), sets, percent))
        if new.isEmpty():
            break
        links = links.unionByName(new)
        comp = checkpoint(components(links))
    rest = checkpoint(cross_candidates(sets, comp, percent, parts * 4))
    more = checkpoint(verify(rest, sets, percent))
    links = links.unionByName(more)
    if not more.isEmpty():
        comp = checkpoint(components(links))
    if count_links:
        copies = checkpoint(rows.groupBy("cid").agg(F.count(F.lit(1)).alias("copies")))
        found = checkpoint(link_counts(sets, comp, copies, percent, block))
        known = copies.join(found, "cid", "left").select("cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
        rows = rows.join(known, "cid", "left").select(
            "_rk", "_id", "n", "cid", F.when(F.col("n") > 0, F.col("_links")).otherwise(0).cast("bigint").alias("n_links"))
    return rows, links, comp


def with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """``(_rk, _id, n, cid, component_id)``: the smallest document id reachable.
    Rows without shingles stand alone."""
    heads = rows.where(F.col("n") > 0).groupBy("cid").agg(F.min("_id").alias("_low"))
    node = heads.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left") \
        .select("cid", "_low", F.coalesce("comp", "cid").alias("comp"))
    low = node.groupBy("comp").agg(F.min("_low").alias("component_id"))
    label = node.join(low, "comp").select("cid", "component_id")
    return (rows.join(label, "cid", "left")
            .withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))))


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but the first (smallest id, then row
    key) of each component; rows without shingles all stay.  Only the keys of
    the rows that go are joined, so the texts need not be shuffled for a short
    list."""
    rows, _, comps = join(docs, size, percent, id_col=id_col, text_col=text_col)
    node = rows.where(F.col("n") > 0).groupBy("_rk").agg(
        F.first("cid").alias("cid"), F.first("_id").alias("_id"), F.count(F.lit(1)).alias("times"))
    node = node.join(comps.select(F.col("node").alias("cid"), "comp"), "cid", "left") \
        .withColumn("comp", F.coalesce("comp", "cid"))
    best = node.groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_rk")).alias("best"))
    node = checkpoint(node.join(best, "comp").select("_rk", "times", (F.col("best._rk") == F.col("_rk")).alias("wins")))
    gone = node.where(~F.col("wins")).select("_rk")
    again = node.where(F.col("wins") & (F.col("times") > 1)).select("_rk")
    key = fresh(docs, "_rk")
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    once = keyed.join(gone.unionByName(again).withColumnRenamed("_rk", key), key, "left_anti")
    first = keyed.join(again.withColumnRenamed("_rk", key), key, "left_semi").dropDuplicates([key])
    return once.unionByName(first).select(*docs.columns)
