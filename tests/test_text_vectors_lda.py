"""Text edge cases, vector kernels against numpy, LDA invariants."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicspark.functions.constants import ENGLISH_STOP_WORDS
from topicspark.operators import lda as L
from topicspark.operators import text as T
from topicspark.operators import vectors as V


EDGE = [(1, None), (2, ""), (3, "   \t\n "), (4, "123 456"), (5, "don't stop"), (6, "I cannot go"),
        (7, "a_b c"), (8, "ÉTÉ 2024\tcats\nboxes"), (9, "Wanna gonna, gimme!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string")


def test_whitespace_tokens_match_python(docs):
    got = {}
    for r in T.whitespace_tokens(docs).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.token))
    for doc_id, text in EDGE:
        exp = (text or "").lower().split() if text is not None else []
        assert [t for _, t in sorted(got.get(doc_id, []))] == exp


def test_stopwords_removed_exactly(docs):
    toks = {r.token for r in T.remove_stopwords(T.whitespace_tokens(docs)).collect()}
    assert "don't" not in toks and "stop" in toks and "i" not in toks


def test_strip_chars_matches_python_re(docs):
    got = {r.doc_id: r.text for r in T.strip_chars(docs).collect()}
    for doc_id, text in EDGE:
        if text is not None:
            assert got[doc_id] == re.sub(r"[\d]|[^\w\s]", " ", text)


def test_clean_text_contractions_and_lemmas(docs):
    got = {r.doc_id: r.text for r in T.clean_and_normalize(docs).collect()}
    assert got[1] == "" and got[2] == "" and got[4] == ""
    assert got[6] == "go"              # cannot -> can not, both stop words
    assert got[7] == "a_b c"           # underscore survives
    assert got[9] == "wan na gon na gim"  # contraction splits, 'me' is a stop word


def test_lemma_rules(spark):
    words = spark.createDataFrame([(w,) for w in ["cats", "cat", "boxes", "box", "wolves", "wolf",
                                                   "women", "woman", "ideas", "glass"]], "word string")
    lm = {r.word: r.lemma for r in T.lemma_table(words).collect()}
    assert lm["cats"] == "cat" and lm["boxes"] == "box" and lm["wolves"] == "wolf"
    assert lm["women"] == "woman"  # on equal length a rule's candidate goes before the word itself
    assert lm["ideas"] == "ideas" and lm["glass"] == "glass"


def test_clean_counts_shuffle_pairs_once(spark, docs):
    """The counts are those of the cleaned text, and (document, word) pairs are
    shuffled once, whether the lemmas are sent to the tasks or joined."""
    more = docs.unionByName(spark.createDataFrame([(1, "cats cat women"), (10, "Boxes box, woman cats!")], docs.schema))
    got = T.clean_word_counts(more)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    clean = T.word_frequencies(T.clean_and_normalize(more))
    want = sorted(map(tuple, clean.groupBy("doc_id", "word").agg(F.sum("cnt")).collect()))
    assert sorted(map(tuple, got.collect())) == want
    rows = T.checkpoint(T.clean_token_rows(more))
    sent, met = (sorted(map(tuple, T.lemma_tokens(rows, sent=n).collect())) for n in (1000, 0))
    assert sent == met and (10, 0, "box") in sent and (10, 3, "cat") in sent


def test_stopword_list_is_fixed():
    assert len(ENGLISH_STOP_WORDS) == 198 and len(set(ENGLISH_STOP_WORDS)) == 198


def test_daily_bags_drop_null_dates(spark):
    c = spark.createDataFrame([(1, "2024-01-01", "a", 2), (2, "2024-01-01", "a", 3), (3, None, "a", 9),
                               (4, "2024-01-02", "b", 1)], "doc_id long, date string, word string, cnt long")
    d = {(r.date, r.word): r.word_freq for r in T.daily_word_frequencies(c).collect()}
    assert d == {("2024-01-01", "a"): 5, ("2024-01-02", "b"): 1}
    bags = spark.createDataFrame([("2024-01-01", {"a": 5}), ("2024-01-02", {"b": 1, "c": 2})],
                                 "date string, word_freq map<string,bigint>")
    long = {(r.date, r.word_id): r.word_freq for r in T.to_long_format(bags).collect()}
    assert long[("2024-01-02", "b")] == 1


def _vecs(spark, X):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(X)), "embedding": list(X)}))


def test_block_topk_matches_numpy(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(60, 8))
    X[5] = X[4]             # duplicate pair
    X[7] = -X[6]            # opposite pair
    u = V.unit_vectors(_vecs(spark, X))
    got = V.knn_exact(u, 5, block_rows=16, min_blocks=3).toPandas()
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    S = Xn @ Xn.T
    for q in range(len(X)):
        s = S[q].copy()
        s[q] = np.inf
        exp = sorted(range(len(X)), key=lambda j: (-s[j], j))[:5]
        assert got[got.q == q].sort_values("rnk").n.tolist() == exp


def test_zero_vector_left_out_and_k_over_n(spark):
    X = np.array([[1.0, 0.0], [0.0, 0.0], [0.6, 0.8]])
    u = V.unit_vectors(_vecs(spark, X))
    assert sorted(r.vec_id for r in u.collect()) == [0, 2]
    got = V.knn_exact(u, 10).collect()
    assert len(got) == 4


def test_hamming_topk_matches_numpy(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 6))
    u = V.unit_vectors(_vecs(spark, X))
    sigs = V.lsh_signatures(u, 64)
    got = V.knn_hamming(sigs, 4, block_rows=8).toPandas()
    P = V.lsh_planes(64, 6)
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    B = (Xn @ P.T >= 0)
    D = (B[:, None, :] != B[None, :, :]).sum(-1)
    for q in range(len(X)):
        d = D[q].astype(float)
        d[q] = -1
        exp = sorted(range(len(X)), key=lambda j: (d[j], j))[:4]
        assert got[got.q == q].sort_values("rnk").n.tolist() == exp


def test_topk_threshold_prefix_vs_filter(spark):
    ranked = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 0.5), (0, 2, 3, 0.1), (0, 3, 4, 0.9)],
                                   "q long, n long, rnk int, sim double")
    pre = sorted(r.n for r in V.topk_threshold(ranked, 0.3, "prefix").collect())
    fil = sorted(r.n for r in V.topk_threshold(ranked, 0.3, "filter").collect())
    assert pre == [0, 1] and fil == [0, 1, 3]


def test_lda_invariants_and_planted_topics(spark):
    rows = []
    for d in range(30):
        group = ["apple", "pear", "plum"] if d % 2 == 0 else ["rock", "stone", "sand"]
        for w in group:
            rows.append((0, d, w, 3))
    inp = spark.createDataFrame(rows, "cluster_id long, document long, ngram string, cnt long")
    fit = L.lda_em(inp, n_topics=2, passes=30)
    ll = fit["loglik"]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(ll[1:], ll[2:]))
    th = fit["theta"].toPandas()
    np.testing.assert_allclose(th[["t0", "t1"]].sum(axis=1), 1.0, atol=1e-12)
    be = fit["beta"].toPandas()
    np.testing.assert_allclose(be[["b0", "b1"]].sum(axis=0), 1.0, atol=1e-12)
    top = th.set_index("document").sort_index()[["t0", "t1"]].idxmax(axis=1)
    assert top[0] != top[1] and len(set(top[::2])) == 1 and len(set(top[1::2])) == 1


def test_text_classes_follow_python(spark):
    """Marks, numerals, connectors and control separators outside the tables' texts."""
    import re
    texts = ["cafe\u0301 na\u00efve", "\u0939\u093f\u0928\u094d\u0926\u0940 text", "x\u00b2 \u00bd \u2460 \u0663 7", "a\u203fb _c",
             "p\x1cq\x1dr\x1es\x1ft\x85u\xa0v\u3000w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in T.strip_chars(df).collect()}
    toks = {}
    for r in T.whitespace_tokens(df).collect():
        toks.setdefault(r.doc_id, {})[r.pos] = r.token
    for i, t in enumerate(texts):
        assert got[i] == re.sub(r"[\d]|[^\w\s]", " ", t)
        assert [toks[i][k] for k in sorted(toks[i])] == t.lower().split()


def test_ties_do_not_depend_on_the_blocks(spark):
    """Groups of equal vectors: the same lists for any block size."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(v) for v in base[i // 3]]) for i in range(180)]
    u = V.unit_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = [sorted(tuple(r) for r in V.knn_exact(u, 5, block_rows=b).collect()) for b in (16384, 100, 37)]
    assert got[0] == got[1] == got[2]


def test_topk_of_query_points_and_tuned_bits(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((50, 8))
    u = V.unit_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                             "vec_id bigint, embedding array<double>"))
    got = V.find_topk(u.where("vec_id < 3"), u, 4).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        assert [r.n for r in sorted(got, key=lambda r: r.rnk) if r.q == q] == np.argsort(-(x @ x[q]))[:4].tolist()
    tuning = V.lsh_tuning(u, 0.3, n_queries=20)
    rows = sorted(tuning.collect(), key=lambda r: r.cell)
    assert [r.chosen for r in rows] == [False] * (len(rows) - 1) + [True]
    assert V.tuned_bits(tuning) == rows[-1].nbits


def test_size_search_goes_beyond_2048_bits(spark, monkeypatch):
    """The registered search at target 0.9 against brute force over the same signatures."""
    from topicspark.plans import vector_queries
    from topicspark.plans.registry import all_queries
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 24))
    u = V.unit_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                             "vec_id bigint, embedding array<double>"))
    monkeypatch.setattr(vector_queries, "_unit", lambda *_: u)
    rows = sorted(all_queries()["lsh_tuning_full"](spark, "unused").collect(), key=lambda r: r.cell)
    assert [r.chosen for r in rows] == [False] * (len(rows) - 1) + [True]
    assert rows[-1].nbits > 2048 and rows[-1].accuracy >= 0.9
    assert [(r.trial, r.bits_per_table, r.n_tables) for r in rows] == \
        [(a, 2 ** a, 2 ** b) for a in range(6, 21) for b in range(1, a)][:len(rows)]
    sims = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    np.fill_diagonal(sims, -2)
    for nbits in sorted({r.nbits for r in rows}):
        sig = {r.vec_id: r.sig for r in V.lsh_signatures(u, nbits).collect()}
        s = np.array([sig[i] for i in range(300)], np.uint64)
        ham = np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(2).astype(int)
        np.fill_diagonal(ham, nbits + 1)
        want = (ham.argmin(1) == sims.argmax(1)).mean()
        assert {r.accuracy for r in rows if r.nbits == nbits} == {round(float(want), 6)}


def test_cleaned_text_of_repeated_ids(spark):
    """Rows that share an id keep their own text; null and empty texts give ''."""
    rows = [(1, "The cats sat, the dogs ran"), (1, "A cat and 3 boxes"), (2, None), (3, "the 12 !"), (4, "box cat dog")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in T.clean_and_normalize(df).collect())
    assert got == [(1, "cat box"), (1, "cat sat dog ran"), (2, ""), (3, ""), (4, "box cat dog")]


def _grouped(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.standard_normal((groups, dim)), n // groups, 0) + 0.05 * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_block_scan_prunes_and_stays_exact(spark):
    """On grouped vectors most blocks are skipped, and the lists are those of brute force."""
    from topicspark.operators import blockscan as B
    x = _grouped(640, 12, 20, 1)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, x array<double>")
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    calls = []

    def counting(name):
        plain = getattr(B, name)
        return lambda kind, balls: calls.append(balls) or plain(kind, balls)

    import unittest.mock
    with unittest.mock.patch.object(B, "_needed", counting("_needed")):
        got = B.topk(df, df, 3, "cosine", "exclude", block_rows=32)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.q, []).append((r.rnk, r.n))
    assert {q: [n for _, n in sorted(v)] for q, v in rows.items()} == \
        {q: sorted(range(640), key=lambda j: (-sims[q, j], j))[:3] for q in range(640)}
    centres, radii, owner = calls[0]
    kth = np.sort(sims, 1)[:, -3]
    away = np.arccos(np.clip(x @ centres.T, -1, 1)) - radii[None, :]
    near = away <= np.arccos(kth)[:, None] + 1e-5
    needed = np.array([near[:, owner == b].any(1) for b in range(20)])
    assert owner.max() == 19 and needed.mean() < 0.25


def test_hamming_scan_with_vectors_and_other_queries(spark):
    x = _grouped(300, 10, 6, 2)
    u = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, v array<double>")
    sigs = V.lsh_signatures(u, 96, keep=True)
    got = V.knn_hamming(sigs, 5, block_rows=40).toPandas()
    s = np.array([r.sig for r in sorted(sigs.collect(), key=lambda r: r.vec_id)], np.uint64)
    ham = np.bitwise_count(s[:, None, :] ^ s[None, :, :]).sum(2).astype(int)
    ham_self = ham.copy()
    np.fill_diagonal(ham_self, -1)
    for q in range(300):
        mine = got[got.q == q].sort_values("rnk")
        want = sorted(range(300), key=lambda j: (ham_self[q, j], j))[:5]
        assert mine.n.tolist() == want and mine.hamming.tolist() == [ham[q, j] for j in want]
        np.testing.assert_allclose(mine.sim, x[want] @ x[q], atol=1e-12)
    grown = V.lsh_signatures(u, 32).join(V.lsh_signatures(u, 96, first=32).withColumnRenamed("sig", "more"), "vec_id") \
        .selectExpr("vec_id", "concat(sig, more) AS sig")
    assert {r.vec_id: list(r.sig) for r in grown.collect()} == {r.vec_id: list(r.sig) for r in sigs.collect()}


def _plain_em(cells, K, passes, alpha=0.1, eta=0.1, seed=42):
    """The same steps, a row per document and cluster, without bags or chunks."""
    import hashlib
    start = lambda k, c, w: 0.5 + int(hashlib.md5(f"{seed}:{k}:{c}:{w}".encode()).hexdigest()[:5], 16) / (1 << 20)
    theta, ll = {}, []
    for c in sorted({c for c, _, _, _ in cells}):
        mine = [x for x in cells if x[0] == c]
        docs, words = sorted({x[1] for x in mine}), sorted({x[2] for x in mine})
        A = np.zeros((len(docs), len(words)))
        for _, d, w, n in mine:
            A[docs.index(d), words.index(w)] = n
        beta = np.array([[start(k, c, w) for w in words] for k in range(K)])
        beta /= beta.sum(1, keepdims=True)
        t = np.full((len(docs), K), 1 / K)
        for p in range(passes):
            mix = t @ beta
            if len(ll) <= p:
                ll.append(0.0)
            ll[p] += (A * np.log(mix)).sum()
            r = t[:, :, None] * beta[None] * (A / mix)[:, None, :]
            by = r.sum(2)
            t = (by + alpha) / (by.sum(1, keepdims=True) + K * alpha)
            beta = r.sum(0) + eta
            beta /= beta.sum(1, keepdims=True)
        theta.update({(c, d): t[i] for i, d in enumerate(docs)})
    return theta, ll


@pytest.mark.parametrize("chunk", [1 << 15, 20])
def test_lda_fits_a_bag_once_with_the_results_of_its_documents(spark, chunk):
    rng = np.random.default_rng(5)
    cells = [(c, d, f"w{c}:{w}", int(rng.integers(1, 3))) for c in (0, 1, 7) for d in range(30)
             for w in range(4) if rng.random() < 0.4]
    inp = spark.createDataFrame(cells, "cluster_id long, document long, ngram string, cnt long")
    fit = L.lda_em(inp, n_topics=3, passes=6, chunk=chunk)
    want, ll = _plain_em(cells, 3, 6)
    got = {(r.cluster_id, r.document): np.array([r.t0, r.t1, r.t2]) for r in fit["theta"].collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert np.allclose(fit["loglik"], ll)
    n = fit["shares"].count()
    assert n < len(want) and fit["shares"].agg(F.sum("m")).first()[0] == len(want)   # a bag is fitted once
    a, b = (sorted(map(tuple, L.topic_weights(L.doc_topics(fit[t])).collect())) for t in ("shares", "theta"))
    assert np.allclose(a, b)


def test_clean_words_are_the_steps_one_after_another(spark):
    texts = ["I cannot go, gonna WANNA x", "İstanbul été ΣΣ a_b 12 x2y ² Ⅷ ٣٤", " \t\u0085", "", None,
             "gimme...lemme gotta-be​not \U0001d7d8\U0001f600ok  z", "Cannot", "cannots"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    steps = T._split_contractions(T.split_words(T.strip_chars_col(F.col("text"))))
    got = df.select("doc_id", T.clean_words(F.col("text")).alias("now"), steps.alias("was")).collect()
    assert all(r.now == r.was for r in got) and got[0].now[1:3] == ["can", "not"]
    plan = df.select(T.clean_words(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert T.WHITESPACE_RE not in plan


def test_words_are_counted_within_their_row(spark):
    rows = spark.createDataFrame([(1, "Cats cat CAT dogs! gonna"), (2, "dog, cats"), (2, "cat"), (None, "cat"), (None, "cats cats"), (3, None), (4, "..."),
                                  (5, "cannot be a word")], "doc_id long, text string")
    per_row = rows.where("doc_id = 1").select(T.counted(T.clean_words(F.col("text"))).alias("e")).first()["e"]
    assert [(e["word"], e["cnt"]) for e in per_row] == [("cat", 2), ("cats", 1), ("dogs", 1), ("gon", 1), ("na", 1)]
    assert rows.where("doc_id = 3").select(T.counted(T.clean_words(F.col("text"))).alias("e")).first()["e"] is None
    for sent in (1000, 0):          # lemmas sent to the tasks, or joined
        got = sorted((r.doc_id or 0, r.word, r.cnt) for r in T.clean_word_counts(rows, sent=sent).collect())
        assert got == [(0, "cat", 3), (1, "cat", 3), (1, "dog", 1), (1, "gon", 1), (1, "na", 1), (2, "cat", 2), (2, "dog", 1), (5, "word", 1)]


def test_cleaned_text_is_split_once(spark):
    plan = spark.range(1).select(T.clean_words(F.lit("a").cast("string")).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1


def test_bags_cut_from_sorted_batches_keep_every_count(spark, monkeypatch):
    """Documents longer than an Arrow batch, null documents and documents cut by a batch's end; no lists are collected."""
    plans, write = [], L.checkpoint
    monkeypatch.setattr(L, "checkpoint", lambda df, **kw: plans.append(df._jdf.queryExecution().toString()) or write(df, **kw))
    rows = [(c, d, w, 1 + (d or 0) % 3) for c in (0, 1) for d in (1, 2, 3, None) for w in "abcdefg"] + [(2, 9, "é", 4), (2, 8, "é", 4)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        held, kinds = L.bags(spark.createDataFrame(rows[::-1], "cluster_id int, document long, ngram string, cnt long"))
        got = {(r.cluster_id, r.document): [(e.ngram, e.cnt) for e in r.bag] for r in held.collect()}
        shared = {(r.cluster_id, r.m) for r in kinds.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: sorted((w, n) for c, d, w, n in rows if (c, d) == k) for k in {r[:2] for r in rows}}
    assert shared == {(0, 1), (0, 2), (1, 1), (1, 2), (2, 2)}
    assert plans and not any("collect_list" in plan for plan in plans)


def _written(spark, but=None) -> dict:
    """Written tables, without those of ``but``, and their rows (of none where ``but`` is empty)."""
    import os
    from urllib.parse import urlparse
    top = urlparse(spark.sparkContext.getCheckpointDir()).path
    names = [t for t in os.listdir(top) if t.startswith("tbl-") and t not in (but or ())]
    return {t: spark.read.parquet(f"{top}/{t}").count() if but else None for t in names}


def test_a_size_search_writes_no_table_per_size(spark):
    """Hits of every size equal brute force, with equal vectors and an id that
    comes twice; the sample, the vectors and the exact neighbours are all that is written."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 6))
    x[7] = x[8]
    ids = np.arange(60)
    ids[50] = 3
    u = V.unit_vectors(spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id bigint, embedding array<double>"))
    sizes, had = [32, 64, 96, 4128], set(_written(spark))
    got = list(V.recalls(u, sizes, 25))
    assert len(set(_written(spark)) - had) <= 3
    asked = {r.vec_id for r in V.query_sample(u, 25).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)

    def nearest(score):
        best = {}
        for i in np.flatnonzero(np.isin(ids, list(asked))):
            for j in np.flatnonzero(ids != ids[i]):
                best[ids[i]] = min(best.get(ids[i], (np.inf, 0)), (-round(score(i, j), 12), ids[j]))
        return {q: n for q, (_, n) in best.items()}

    exact = nearest(lambda i, j: float((x[i] * x[j]).sum()))
    bits = x @ V.lsh_planes(4128, 6).T >= 0
    want = [nearest(lambda i, j, b=b: -float((bits[i, :b] != bits[j, :b]).sum())) for b in sizes]
    assert got == [(b, len(exact), sum(w[q] == exact[q] for q in exact)) for b, w in zip(sizes, want)]
