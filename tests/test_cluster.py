"""Clustering: the properties that define each result, checked on the output."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from testpaths import SF_SMALL
from topicspark.operators import cluster as C
from topicspark.operators import vectors as V
from topicspark.operators.peel import rank_peel
from topicspark.sources import tables


@pytest.fixture(scope="module")
def unit_small(spark):
    u = V.unit_vectors(tables.embeddings(spark, SF_SMALL))
    pdf = u.orderBy("vec_id").toPandas()
    return u, np.stack(pdf.v.to_numpy())


def _as_map(df):
    return {r.vec_id: r.cluster_id for r in df.collect()}


def _lists(u, k):
    out = {}
    for r in C.neighbor_lists(u, k).collect():
        out.setdefault(r.u, set()).add(r.v)
    return out


def _check_claims(member, lists, rank):
    """Greedy claiming: clusters are numbered by their heads' ranks; no head
    stands in an earlier head's list; everyone else belongs to the earliest
    head that lists it."""
    heads = {}
    for p, c in member.items():
        if c not in heads or rank[p] < rank[heads[c]]:
            heads[c] = p
    order = [heads[c] for c in sorted(heads)]
    assert sorted(heads) == list(range(len(heads)))
    assert [rank[h] for h in order] == sorted(rank[h] for h in order)
    for i, h in enumerate(order):
        assert not any(h in lists[e] for e in order[:i])
    listing = {p: [i for i, h in enumerate(order) if p in lists[h]] for p in member}
    assert all(member[p] == listing[p][0] for p in member)


def test_sequential_claims(unit_small):
    u, X = unit_small
    got = _as_map(C.sequential_cluster(u, 10))
    assert len(got) == len(X)
    _check_claims(got, _lists(u, 10), {p: p for p in got})


def test_seeded_claims(unit_small):
    u, X = unit_small
    got = _as_map(C.seeded_cluster(u, [7, 3, 400, 123, 3], 10))
    rank = {p: p for p in got}
    rank.update({7: -4, 3: -3, 400: -2, 123: -1})
    _check_claims(got, _lists(u, 10), rank)


def test_merge_rounds(unit_small):
    """Every pair of a round is a nearest pair above the threshold whose
    second cluster was still free, and a round leaves no free pair."""
    u, X = unit_small
    members = C.singletons(u)
    for _ in range(2):
        before = _as_map(members)
        members = C.merge_round(members, u, 0.3)
        after = _as_map(members)
        m = max(before.values()) + 1
        ids = np.array([before[p] for p in range(len(X))])
        cents = np.stack([X[ids == c].mean(axis=0) for c in range(m)])
        sims = cents @ cents.T / np.outer(np.linalg.norm(cents, axis=1), np.linalg.norm(cents, axis=1))
        np.fill_diagonal(sims, -2.0)
        into = {}
        for p in range(len(X)):
            into.setdefault(after[p], set()).add(int(ids[p]))
        assert all(len(v) <= 2 for v in into.values())
        mate = {min(v): max(v) for v in into.values() if len(v) == 2}
        target = set(mate.values())
        for i in range(m):
            near = int(np.argmax(sims[i]))
            above = sims[i, near] > 0.3
            if i in mate:
                assert above and near == mate[i] or mate[i] == near
            elif i not in target and above:
                # its nearest was taken before i came: as a head of a smaller number or as a mate
                owner = next(k for k, v in into.items() if near in v)
                assert min(into[owner]) < i


def test_hierarchical_stops_by_rule(unit_small):
    u, X = unit_small
    members, hist = C.hierarchical_cluster(u, 40, 0.3)
    assert hist[0][0] == len(X) and all(a[1] == b[0] for a, b in zip(hist, hist[1:]))
    assert all(m > 40 and m - n >= 10 for m, n in hist[:-1])
    last = hist[-1]
    assert last[1] <= 40 or last[0] - last[1] < 10
    assert members.select("cluster_id").distinct().count() == last[1] and members.count() == len(X)


def test_peel_chain_and_star(spark):
    # chain 0->1->2->3: heads 0 and 2; star: 0 claims everyone
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "u long, v long")
    ranks = spark.createDataFrame([(i, i) for i in range(4)], "node long, rnk long")
    out, rounds = rank_peel(edges, ranks)
    assert {r.node: r.cluster_id for r in out.collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "u long, v long")
    ranks5 = spark.createDataFrame([(i, i) for i in range(5)], "node long, rnk long")
    out, _ = rank_peel(star, ranks5)
    assert {r.cluster_id for r in out.collect()} == {0}


def test_every_point_in_one_cluster(unit_small):
    u, X = unit_small
    m = C.sequential_cluster(u, 25)
    assert m.count() == len(X) == m.select("vec_id").distinct().count()


def test_centroids_unit_length(unit_small, spark):
    u, X = unit_small
    members = spark.createDataFrame(pd.DataFrame({"vec_id": [0, 1, 2], "cluster_id": [0, 0, 1]}))
    cents = {r.cluster_id: np.array(r.v) for r in C.centroids(members, u).collect()}
    exp0 = (X[0] + X[1]) / np.linalg.norm(X[0] + X[1])
    np.testing.assert_allclose(cents[0], exp0, atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(cents[1]), 1.0, atol=1e-12)


def test_rounds_follow_the_ranges_not_the_chain(spark):
    """Points whose lists are their five neighbours on either side, in id
    order: the longest chain is as long as the table."""
    for n in (400, 2000):
        edges = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.col("id") - 5, F.col("id") + 5)).alias("v")) \
            .where(f"v >= 0 and v < {n}")
        ranks = spark.range(n).select(F.col("id").alias("node"), F.col("id").alias("rnk"))
        out, rounds = rank_peel(edges, ranks)
        got = {r.node: r.cluster_id for r in out.collect()}
        assert got == {i: i // 6 for i in range(n)} and rounds <= 5


def test_peel_is_the_same_for_any_range(spark):
    rng = np.random.default_rng(6)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 120, (500, 2))})
    edges = spark.createDataFrame(pairs, "u long, v long")
    order = rng.permutation(120)
    ranks = spark.createDataFrame([(int(x), i) for i, x in enumerate(order)], "node long, rnk long")
    lists = {i: {i} for i in range(120)}
    for a, b in pairs:
        lists[a].add(b)
    got = [{r.node: r.cluster_id for r in rank_peel(edges, ranks, w)[0].collect()} for w in (7, 1000)]
    assert got[0] == got[1]
    _check_claims(got[0], lists, {int(x): i for i, x in enumerate(order)})


def test_hierarchical_equals_repeated_rounds(unit_small):
    """What is kept between rounds gives what a full search in every round gives."""
    u, X = unit_small
    got, hist = C.hierarchical_cluster(u, 40, 0.3)
    members, m, counts = C.singletons(u), len(X), []
    while m > 40:
        members = C.merge_round(members, u, 0.3)
        after = _as_map(members)
        counts.append((m, len(set(after.values()))))
        merged, m = m - counts[-1][1], counts[-1][1]
        if merged < 10:
            break
    assert hist == counts and _as_map(got) == after


def test_cluster_word_pieces(spark):
    rows = [(f"w{i:03d}", 1 if i < 25 else 2) for i in range(40)]
    got = C.cluster_word_pieces(spark.createDataFrame(rows, "ngram string, cluster_id bigint"), 10)
    got = {(r.cluster_id, r.piece): (r.n_words, r.words.split(" ")) for r in got.collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 0): 10, (1, 1): 10, (1, 2): 5, (2, 0): 10, (2, 1): 5}
    assert sum((got[k][1] for k in sorted(got)), []) == [r[0] for r in rows]


@pytest.mark.parametrize("kind", ["cosine", "hamming"])
def test_scan_works_in_bounded_memory(kind):
    """A block of queries meets a full block of candidates; the working memory
    is a few tiles of scores, and the lists are those of a plain scan."""
    import tracemalloc

    import pyarrow as pa
    from topicspark.operators import blockscan as B
    rng, n, k = np.random.default_rng(3), B.BLOCK_ROWS, 10
    if kind == "cosine":
        x = rng.normal(size=(n, 16))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    else:
        x = rng.integers(0, 2 ** 32, (n, 1), dtype=np.uint64)
    some = 1024

    def part(kind_, cb, rows):
        m, far = len(rows), pa.nulls(len(rows), pa.float64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int64)), pa.array(np.full(m, kind_)), pa.array(np.zeros(m)),
             pa.array(np.full(m, cb)), pa.array(rows), pa.array([r.tobytes() for r in x[rows]], pa.binary()), pa.nulls(m, pa.binary()),
             far, pa.nulls(m, pa.int64())], names=["qb", "stripe", "kind", "ord", "cb", "id", "vec", "pay", "bound", "tie"])

    metric = B.METRICS[kind]
    parts = [part(0, -1, np.arange(some)), part(1, 0, np.arange(n))]
    run = B._scan(kind, k, True, (metric.centre(x)[None], np.array([1e9]), np.zeros(1, np.int64)))
    tracemalloc.start()
    out = pa.Table.from_batches(list(run(iter(parts)))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    score = metric.scores(x[:some], x)
    score[np.arange(some), np.arange(some)] = -np.inf
    for q in range(0, some, 97):
        assert sorted(out[out.q == q].n) == sorted(np.lexsort((np.arange(n), -score[q]))[:k])


@pytest.mark.parametrize("K,how", [(60, {}), (125, {"method": "lsh", "nbits": 96, "hash_above": 100})])
def test_last_rounds_in_one_task_give_the_same(spark, monkeypatch, K, how):
    """Rounds of jobs and the tail of a fixed number of clusters agree, with
    copies, opposite vectors (a mean without direction) and a repeated id; the
    tail writes a few tables however many rounds it works."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 6))
    x = np.vstack([x, x[:8], -x[20:24], -x[20:24]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[3].tolist())]
    u = spark.createDataFrame(rows, "vec_id long, v array<double>")
    want, rounds = C.hierarchical_cluster(u, K, 0.2, 1, tail=0, **how)
    tables, write = [], C.checkpoint
    monkeypatch.setattr(C, "checkpoint", lambda *a, **k: tables.append(a) or write(*a, **k))
    got, hist = C.hierarchical_cluster(u, K, 0.2, 1, **how)
    assert hist == rounds and hist and len(tables) <= 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hamming_scores_work_in_the_cache():
    """Long signatures are counted exactly, and beside the scores there are
    only small temporaries."""
    import tracemalloc

    from topicspark.operators import blockscan as B
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2 ** 63, (n, 1100), dtype=np.uint64) for n in (3, 5))
    a[0], b[0] = 0, np.uint64(2 ** 64 - 1)
    got = B.Hamming.scores(a, b)
    assert got[0, 0] == -64 * 1100
    assert got.tolist() == (-np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2).astype(float)).tolist()
    a, b = rng.integers(0, 2 ** 63, (B.TILE, 2), dtype=np.uint64), rng.integers(0, 2 ** 63, (B.BLOCK_ROWS, 2), dtype=np.uint64)
    tracemalloc.start()
    out = B.Hamming.scores(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * out.nbytes


def test_both_methods_walk_one_table_of_lists(spark, monkeypatch):
    from topicspark.plans import topic_queries
    calls, lists = [], C.neighbor_lists
    monkeypatch.setattr(C, "neighbor_lists", lambda *a, **k: calls.append(a) or lists(*a, **k))
    table = topic_queries.method_inputs(spark, SF_SMALL)[1]
    assert len(calls) == 1
    assert {"sequential_cluster", "seeded_cluster"} < set(table.columns) and table.count()


def test_joined_query_blocks_give_the_same_lists(spark, monkeypatch):
    from topicspark.operators import blockscan as B
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6))
    x[200:] = x[:200] + 1e-9 * rng.normal(size=(200, 6))          # closer than single precision tells
    x /= np.sqrt((x * x).sum(1))[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    seen = []
    scan = B._scan
    monkeypatch.setattr(B, "_scan", lambda *a: seen.append(a) or scan(*a))
    cells = []
    monkeypatch.setattr(B, "SPREAD", type("S", (), {"__mul__": lambda s, n: cells.append(n) or n})())
    got = {}
    for r in B.topk(rows, rows, 5, "cosine", "exclude", block_rows=8).collect():
        got.setdefault(r.q, []).append((r.rnk, r.n))
    assert cells[0] == 17                                         # 50 blocks, three of them held together
    score = (x[:, None, :] * x[None, :, :]).sum(2)
    np.fill_diagonal(score, -np.inf)
    for q in range(400):
        assert [n for _, n in sorted(got[q])] == np.lexsort((np.arange(400), -score[q]))[:5].tolist()


def test_best_keeps_what_other_queries_hold():
    from topicspark.operators.blockscan import Best, _same
    rng = np.random.default_rng(1)
    best, given = Best(np.full(6, -np.inf), np.full(6, -1), 3), []
    for part in range(20):
        q, n, score = rng.integers(0, 6, 9), np.arange(9) + 9 * part, rng.integers(0, 5, 9).astype(float)
        given += list(zip(q.tolist(), n.tolist(), score.tolist()))
        best.add(q, n, score, None)
    q, n, score, _ = best.rows()
    want = [r for i in range(6) for r in sorted((g for g in given if g[0] == i), key=lambda g: (-g[2], g[1]))[:3]]
    assert list(zip(q.tolist(), n.tolist(), score.tolist())) == want
    cid = np.array([4, 2, 4, 9])
    i, j = _same(np.array([9, 4, 7]), cid, np.argsort(cid, kind="stable"))
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 3), (1, 0), (1, 2)]


def test_sums_of_a_cluster_cut_by_batches(spark):
    """Centroids of clusters longer than an Arrow batch, a zero mean and a cluster without vectors; one column of sums."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 6))
    x[1] = -x[0]
    ids = [9, 9] + [i % 3 for i in range(38)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    members = spark.createDataFrame([(i, c) for i, c in enumerate(ids)] + [(99, 5)], "vec_id long, cluster_id int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        sums = C.vector_sums(members, vectors)
        assert dict(sums.dtypes) == {"cluster_id": "int", "n": "bigint", "total": "array<double>"}
        got = {r.cluster_id: np.array(r.v) for r in C.centroids(members, vectors).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {0, 1, 2}
    for c, v in got.items():
        mean = x[np.array(ids) == c].mean(0)
        np.testing.assert_allclose(v, mean / np.linalg.norm(mean), atol=1e-12)


def test_merge_rounds_by_hash_send_signatures_and_match_in_one_range(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 16)) + 3 * np.eye(16)[rng.integers(0, 16, 300)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    sent, rounds, scan, peel = [], [], V.topk, C.rank_peel
    monkeypatch.setattr(V, "topk", lambda q, c, *a, **kw: sent.append(c.columns) or scan(q, c, *a, **kw))
    monkeypatch.setattr(C, "rank_peel", lambda *a, **kw: (got := peel(*a, **kw), rounds.append(got[1]))[0])
    whole = C.hierarchical_cluster(vectors, 220, 0.3, method="lsh", hash_above=100, nbits=64, tail=0)
    assert sent and all(c == ["id", "x"] for c in sent) and set(rounds) == {1}
    last = C.hierarchical_cluster(vectors, 220, 0.3, method="lsh", hash_above=100, nbits=64)
    assert whole[1] == last[1]
    assert sorted(map(tuple, whole[0].collect())) == sorted(map(tuple, last[0].collect()))


def test_merge_rounds_leave_no_superseded_tables(spark):
    """After rounds of jobs only the vectors, the last state and small tables hold rows."""
    from test_text_vectors_lda import _written
    x = np.random.default_rng(6).standard_normal((24, 4))
    u = V.unit_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>"))
    had = set(_written(spark, ()))
    members, history = C.hierarchical_cluster(u, 8, 0.1, 2, tail=0)
    assert len(history) > 1 and members.count() == 24
    assert sum(n > 0 for n in _written(spark, had).values()) <= 12


def test_written_tables_leave_no_shuffle_files(spark):
    """Spark removes them when the table is written; the session's setting stays as it was."""
    from topicspark import session as S
    seen = []
    df = spark.range(100).repartition(3, "id").mapInPandas(lambda batches: batches, "id long")
    before = spark.conf.get(S.CLEANUP, "false")
    with S._shuffles_dropped(spark):
        seen.append(spark.conf.get(S.CLEANUP))
    with S.superseded() as keep:
        first, last = S.checkpoint(df), keep(S.checkpoint(df))
        path = first.written_to
    assert seen == ["true"] and spark.conf.get(S.CLEANUP, "false") == before
    assert last.count() == 100 and spark.read.parquet(path).count() == 0
