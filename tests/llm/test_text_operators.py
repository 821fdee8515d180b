"""Operators 1, 3, 4 and 9 against brute force, and their edge cases."""

import collections
import hashlib
import re

import numpy as np
import pytest

from cases import edge_rows
from topicspark.llm import bwt, jaccard_join, packing, repeats, sharding
from topicspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def key(v):
    return (v is not None, v if v is not None else 0)


# ------------------------------------------------------------------ 1

def brute_cut(rows, length):
    """Per distinct (id, text) in order: bytes, removed, runs, digest."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (key(r[0]), r[1] or "")):
        raw = (t or "").encode()
        on = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            if w in seen:
                on[k:k + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())
        kept = bytes(b for b, o in zip(raw, on) if not o)
        out[(i, t)] = (len(raw), int(on.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_long_prefix_groups_match_sorted_suffixes():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = rng.integers(97, 97 + rng.integers(1, 4), 80).astype(np.uint8)
        parts = []
        for _ in range(rng.integers(1, 30)):
            a = rng.integers(0, 60)
            parts.append(np.append(base[a:a + rng.integers(0, 40)], 0).astype(np.uint8))
        text, least = np.concatenate(parts), int(rng.integers(1, 20))
        order, group = bwt.long_prefix_groups(text, least)
        ends = np.flatnonzero(text == 0)
        suffix = [bytes(text[i:ends[np.searchsorted(ends, i)]]) for i in order]
        assert suffix == sorted(suffix)
        for i in range(1, len(order)):
            a, b = suffix[i - 1][:least], suffix[i][:least]
            assert (group[i] == group[i - 1]) == (a == b and len(a) == least)


def test_repeats_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    want = brute_cut(list(zip(docs.doc_id, docs.text)), 100)
    want = {i: v for (i, _), v in want.items()}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("length", [100, 60])
def test_repeats_edges(spark, edge, length):
    # equal texts are ordered by (id, row key); with distinct ids the order is that of the ids
    rows = [(r[0], r[1]) for r in edge_rows()]
    got = repeats.cut_column(repeats.find(edge, length=length)).collect()
    want = brute_cut(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (r._cut.n_bytes, r._cut.n_removed, r._cut.n_spans, r._cut.kept_sha256) == want[(r.doc_id, r.text)]
        assert (r.score, r.idx, r._rk) == (0.5, 7, "mine")


def test_repeats_keep_the_first_of_repeated_rows(spark):
    """Rows equal in id and text count once, also where they are the first of their text."""
    rng = np.random.default_rng(8)
    a, b = ("".join(chr(c) for c in rng.integers(97, 123, 400)) for _ in range(2))
    rows = [(1, a), (1, a), (2, a), (3, b[:250]), (3, b[:250]), (3, b[:250]), (4, "x" + b), (None, b[50:]), (None, b[50:])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = repeats.cut_column(repeats.find(docs)).collect()
    want = brute_cut(rows, 100)
    assert len(got) == len(rows)
    for r in got:
        assert (r._cut.n_bytes, r._cut.n_removed, r._cut.n_spans, r._cut.kept_sha256) == want[(r.doc_id, r.text)]


def test_repeats_in_a_very_long_text(spark):
    rng = np.random.default_rng(0)
    word = "".join(chr(c) for c in rng.integers(97, 123, 300))
    noise = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in (5_000_000, 4_500_000)]
    docs = spark.createDataFrame([(1, noise[0] + word + noise[1] + word + "tail")], "doc_id bigint, text string")
    r = repeats.cut_column(repeats.find(docs)).first()._cut
    assert (r.n_removed, r.n_spans) == (300, 1) and r.spans[0] == 9_500_300


def test_cut_text_keeps_whole_characters(spark):
    body = "é" * 60
    docs = spark.createDataFrame([(1, body, 60), (2, "a" + body + "b", 62), (3, None, None)],
                                 "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in repeats.cut_text(repeats.find(docs), chars_col="n_chars").collect()}
    assert got[1][0] == "é" * 50 or got[1][0] == body[:len(got[1][0])]
    assert got[2] == ("ab", 2) and got[3] == (None, None)


# ------------------------------------------------------------------ 3

def shingle_set(text, size=5):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1)))


def brute_components(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def brute_link_counts(rows, percent=75):
    sets = [shingle_set(t) for _, t in rows]
    return [sum(100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets) if j != i and a and b) for i, a in enumerate(sets)]


def test_jaccard_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    rows = list(zip(docs.doc_id, docs.text))
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in QUERIES["op3_jaccard_join"](spark, SF).collect())
    assert got == sorted((*c, n) for c, n in zip(brute_components(rows), brute_link_counts(rows)))


def test_jaccard_edges(spark, edge):
    got = jaccard_join.with_components(*[x for k, x in enumerate(jaccard_join.join(edge, fragment=500, segment=200)) if k != 1])
    got = sorted(((r._id, r.n, r.component_id) for r in got.collect()), key=str)
    assert got == sorted(brute_components([(r[0], r[1]) for r in edge_rows()]), key=str)


def test_jaccard_links_that_no_star_finds(spark):
    """Chains and near misses of a base text: components need the prefix filter."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for k in rng.choice(120, rng.integers(0, 6), replace=False):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    rows_, _, comps = jaccard_join.join(docs, fragment=2000, segment=1000)
    got = sorted((r._id, r.n, r.component_id) for r in jaccard_join.with_components(rows_, comps).collect())
    assert got == sorted(brute_components(rows))


def test_jaccard_link_counts_in_blocks(spark, monkeypatch):
    """Groups of copies and near copies larger than a block, next to others; long texts over several column slices."""
    monkeypatch.setattr(jaccard_join, "COLUMNS", 64)
    rng = np.random.default_rng(6)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(90)]
        for i in range(25):
            w = list(base)
            for k in rng.choice(90, rng.integers(0, 5), replace=False):
                w[k] = f"x{i}_{k}"
            rows.append((100 * g + i, " ".join(w)))
        rows += [(100 * g + 50 + i, " ".join(base)) for i in range(6)]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A  b"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got, _, _ = jaccard_join.join(docs, fragment=2000, segment=1000, count_links=True, block=8)
    want = collections.Counter((i, n) for (i, _), n in zip(rows, brute_link_counts(rows)))
    assert collections.Counter((r._id, r.n_links) for r in got.collect()) == want


def test_keep_one(spark, edge):
    kept = jaccard_join.keep_one(edge)
    assert kept.columns == edge.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    comps = brute_components([(r[0], r[1]) for r in edge_rows()])
    stay = collections.Counter({c for d, n, c in comps if n} | {d for d, n, _ in comps if not n})
    assert ids == stay


# ------------------------------------------------------------------ 4

def check_packing(rows, capacity, per_source, sizes):
    spans = collections.defaultdict(list)
    load, sources, clusters = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        spans[r.doc_id].append((r.word_from, r.word_to))
        load[r.bin_id] += r["size"]
        if r.source is not None:
            sources[(r.bin_id, r.source)] += 1
        if r.cluster is not None:
            clusters[(r.bin_id, r.cluster)] += 1
    assert max(load.values()) <= capacity
    assert max(sources.values()) <= per_source and max(clusters.values()) == 1
    got = {i: sum(z - a for a, z in v) for i, v in spans.items()}
    assert got == sizes
    return load


def test_packing_edges(spark, edge):
    rows = packing.pack(edge, capacity=64, group_rows=8).collect()
    sizes = collections.Counter()
    for r in edge_rows():
        sizes[r[0]] += len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) + 1
    check_packing(rows, 64, packing.PER_SOURCE, dict(sizes))


def test_packing_is_best_fit(spark):
    """One group: the same bins as a plain scan for the tightest compatible bin."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))) + f" t{i % 40}", f"s{i % 5}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.pack(docs, capacity=64, per_source=1, group_rows=1000).collect()
    bins = []
    items = sorted(((len(t.split()) + 1, d, s, t) for d, t, s in rows), key=lambda x: (-x[0], x[1]))
    where = {}
    for size, d, s, t in items:
        fit = [(64 - b["load"], n) for n, b in enumerate(bins)
               if 64 - b["load"] >= size and s not in b["s"] and t not in b["t"]]
        n = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"load": 0, "s": set(), "t": set()})
        bins[n]["load"] += size
        bins[n]["s"].add(s)
        bins[n]["t"].add(t)
        where[d] = n
    assert {r.doc_id: r.bin_id for r in got} == where


# ------------------------------------------------------------------ 9

def test_differencing_keeps_sums():
    rng = np.random.default_rng(2)
    v = np.zeros((50, 4))
    v[:, 0] = rng.integers(1, 1000, 50)
    label, sums = sharding.difference(v)
    again = np.zeros(4)
    for i in range(50):
        again[label[i]] += v[i]
    assert (np.sort(again) == np.sort(sums)).all() and np.ptp(sums) <= v.max()


@pytest.mark.parametrize("chunk", [4, 1000])
def test_sharding_edges(spark, edge, chunk):
    rows = sharding.shard(edge, shards=3, chunk_rows=chunk).collect()
    assert len(rows) == len(edge_rows())
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 8) for r in edge_rows())
    assert collections.Counter((r.doc_id, r["size"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in rows if r.doc_id in (3, 4)}) == 1


def test_sharding_is_tight(spark):
    got = QUERIES["op9_sharding"](spark, SF).toPandas()
    total = got.groupby("shard")["size"].sum()
    assert len(total) == 24 and total.max() - total.min() <= got["size"].max()


def test_empty_tables(spark, empty):
    assert repeats.cut_column(repeats.find(empty)).count() == 0
    rows, links, comps = jaccard_join.join(empty)
    assert jaccard_join.with_components(rows, comps).count() == 0 and links.count() == 0
    assert jaccard_join.keep_one(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert sharding.shard(empty).count() == 0


def test_working_memory_does_not_follow_the_batch():
    """Twelve megabytes of text in one batch: the kernels of operators 1 and 3 work on slices."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from topicspark.llm import jaccard_join, repeats
    from topicspark.llm import textio
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = pa.array([" ".join(words[rng.integers(0, 5000, 400)]) for _ in range(5200)])
    batch = pa.record_batch({"_text": texts})
    data, off = textio.text_bytes(texts)
    assert len(data) > 11e6

    def peak(work):
        tracemalloc.start()
        for _ in work():
            pass
        got = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return got

    assert peak(lambda: jaccard_join._batch_sets(batch, 5)) < 130e6
    assert peak(lambda: [repeats._all_blocks(data, off, 100)] and []) < 60e6


def test_item_sizes_work_in_small_slices():
    import tracemalloc

    import pyarrow as pa
    texts = pa.array(["two words " * 500, None, "", " x "] * 3000)
    tracemalloc.start()
    got = packing.item_size.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [1001, 1, 1, 2] * 3000
    assert peak < 24e6, peak
