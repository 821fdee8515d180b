"""Topic operators: L1 totals, LSA against a dense numpy SVD twin."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from testpaths import SF_SMALL
from topicspark.operators import topics as TP


def _dense(cdw_pdf):
    mats = {}
    for cid, g in cdw_pdf.groupby("cluster_id"):
        m = g.pivot_table(index="document", columns="ngram", values="cnt", aggfunc="sum", fill_value=0)
        mats[cid] = m
    return mats


def test_l1_totals_agree(spark):
    cdw = spark.createDataFrame(pd.DataFrame({
        "cluster_id": [0, 0, 0, 1, 1], "document": [1, 1, 2, 1, 3],
        "ngram": ["a", "b", "a", "c", "c"], "cnt": [2, 1, 3, 5, 1]}))
    load = {(r.cluster_id, r.document): r.loading for r in TP.l1_doc_loading(cdw).collect()}
    assert load == {(0, 1): 3, (0, 2): 3, (1, 1): 5, (1, 3): 1}
    words = {(r.cluster_id, r.ngram): r.weight for r in TP.l1_topic_words(cdw).collect()}
    assert words[(0, "a")] == pytest.approx(5 / 6) and words[(1, "c")] == pytest.approx(1.0)
    imp = {r.cluster_id: (r.total, r.share_sum) for r in TP.l1_importance(cdw).collect()}
    assert imp[0][0] == 6 and imp[0][1] == pytest.approx(1.0)


def test_cluster_doc_word_sums_duplicates(spark):
    counts = spark.createDataFrame(pd.DataFrame({
        "document": [1, 1, 2], "ngram": ["a", "a", "z"], "count": [2, 3, 1]}))
    wc = spark.createDataFrame(pd.DataFrame({"ngram": ["a", "b"], "cluster_id": [0, 0]}))
    rows = TP.cluster_doc_word(counts, wc).collect()
    assert [(r.cluster_id, r.document, r.ngram, r.cnt) for r in rows] == [(0, 1, "a", 5)]


def test_lsa_matches_dense_svd(spark):
    from topicspark.plans.topic_queries import doc_word
    cdw, wc = doc_word(spark, SF_SMALL)
    status = TP.lsa_status(wc, cdw, 2)
    ok = [r.cluster_id for r in status.where("status = 'ok'").collect()]
    cdw_ok = cdw.where(F.col("cluster_id").isin(ok))
    res = TP.lsa(cdw_ok, 2)
    pdf = cdw_ok.toPandas()
    mats = _dense(pdf)
    sig = res["singular"].toPandas()
    words = res["words"].toPandas()
    loads = res["loadings"].toPandas()
    assert len(ok) > 3
    for cid, m in mats.items():
        A = m.to_numpy(dtype=float)
        U, s, Vt = np.linalg.svd(A, full_matrices=False)
        got = sig[sig.cluster_id == cid].sort_values("topic").sigma.to_numpy()
        np.testing.assert_allclose(got, s[:2], rtol=1e-7, atol=1e-9)
        for t in (1, 2):
            if s[t - 1] < 1e-9 * s[0] or (t == 2 and abs(s[0] - s[1]) < 1e-6 * s[0]):
                continue
            v = Vt[t - 1].copy()
            j = np.lexsort((np.array(m.columns), -np.abs(v)))[0]
            v *= np.sign(v[j])
            w = words[(words.cluster_id == cid) & (words.topic == t)].set_index("ngram").weight
            np.testing.assert_allclose(w.reindex(m.columns).to_numpy(), v, atol=1e-6)
            lv = loads[(loads.cluster_id == cid) & (loads.topic == t)].set_index("document").loading
            np.testing.assert_allclose(lv.reindex(m.index).to_numpy(), A @ v, atol=1e-5)


@pytest.mark.parametrize("big", [100, 3000, 100000])
def test_lsa_keeps_a_weak_second_topic(spark, big):
    """One word dominates the cluster; the second topic must not be lost."""
    rows = [(0, 1, "a", big), (0, 2, "b", 1), (0, 2, "c", 1), (0, 3, "d", 1), (0, 4, "e", 1), (0, 3, "a", 2)]
    cdw = spark.createDataFrame(rows, "cluster_id bigint, document bigint, ngram string, cnt bigint")
    res = TP.lsa(cdw, 2)
    m = _dense(cdw.toPandas())[0]
    _, s, vt = np.linalg.svd(m.to_numpy(float), full_matrices=False)
    got = {r.topic: (r.sigma, r.converged) for r in res["singular"].collect()}
    np.testing.assert_allclose([got[1][0], got[2][0]], s[:2], rtol=1e-6)
    assert got[1][1] and got[2][1]
    w = {(r.topic, r.ngram): r.weight for r in res["words"].collect()}
    second = np.array([w[(2, c)] for c in m.columns])
    assert abs(abs(second @ vt[1]) - 1) < 1e-6


def test_lsa_goes_on_while_a_flat_spectrum_converges(spark):
    """Singular values close together, more words than one basis holds: no step solves it at once."""
    s = np.concatenate([[10.0, 9.9], np.linspace(9.4, 6.0, 58)])
    rows = [(0, i, f"w{i:02d}", float(v)) for i, v in enumerate(s)]
    cdw = spark.createDataFrame(rows, "cluster_id bigint, document bigint, ngram string, cnt double")
    res = TP.lsa(cdw, 2, oversample=2, chunk=16, word_part=16)
    got = {r.topic: (r.sigma, r.converged) for r in res["singular"].collect()}
    assert got[1][1] and got[2][1] and res["iterations"] > 3
    np.testing.assert_allclose([got[1][0], got[2][0]], s[:2], rtol=1e-10)
    w = {(r.topic, r.ngram): r.weight for r in res["words"].collect()}
    assert abs(w[1, "w00"] - 1) < 1e-9 and abs(w[2, "w01"] - 1) < 1e-9


def test_lsa_does_not_depend_on_the_chunks(spark):
    """A cluster in one chunk or in many, its words in one part or in several."""
    rng = np.random.default_rng(7)
    rows = [(c, d, f"w{w}", float(n)) for c in (0, 1) for d in range(40) for w in range(60) if (n := rng.poisson(0.3 + (w + d) % 7 / 9))]
    cdw = spark.createDataFrame(rows, "cluster_id bigint, document bigint, ngram string, cnt double")
    got = []
    for kw in ({}, {"chunk": 100, "word_part": 9}):
        res = TP.lsa(cdw, 2, **kw)
        got.append((sorted((r.cluster_id, r.topic, round(r.sigma, 8)) for r in res["singular"].collect()),
                    sorted((r.cluster_id, r.topic, r.ngram, round(r.weight, 6) + 0.0) for r in res["words"].collect()),
                    sorted((r.cluster_id, r.topic, r.document, round(r.loading, 5) + 0.0) for r in res["loadings"].collect())))
    assert got[0] == got[1]


def test_superseded_tables_are_emptied(spark, tmp_path):
    from topicspark.session import checkpoint, discard
    df = checkpoint(spark.range(1000))
    path = df.written_to
    discard(df)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["id"]


def test_counts_of_one_row_per_word_are_not_shuffled(spark):
    """``distinct`` counts meet the words where they are; words that come
    twice in a cluster, or in two, count as in the general form."""
    from topicspark.operators import lda as L
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 3), (None, "a", 5), (2, "c", 4)],
                                   "document long, ngram string, count long")
    wc = spark.createDataFrame([("a", 0), ("a", 0), ("a", 1), ("b", 1), ("d", 1), ("c", None)], "ngram string, cluster_id long")
    for f in (TP.cluster_doc_word, L.lda_input):
        got = f(counts, wc, distinct=True)
        want = f(counts, wc)
        assert got.columns == want.columns and got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_clusters_of_few_words_need_no_iteration(spark):
    """They are solved from the factor of their chunks, however many it is reduced over."""
    rng = np.random.default_rng(11)
    rows = [(c, d, f"w{w}", float(n)) for c in (0, 1) for d in range(60) for w in range(50) if (n := rng.poisson(0.4 + (w * (c + 1) + d) % 7 / 9))]
    rows += [(c, 1000 + d, f"w{d % 50}", float(1 + d % 3)) for c in (0, 1) for d in range(300)]      # documents with one entry
    cdw = spark.createDataFrame(rows, "cluster_id bigint, document bigint, ngram string, cnt double")
    got = []
    for kw in ({}, {"chunk": 20}):
        res = TP.lsa(cdw, 2, **kw)
        assert res["iterations"] == 0 and all(r.converged for r in res["singular"].collect())
        got.append((sorted((r.cluster_id, r.topic, round(r.sigma, 8)) for r in res["singular"].collect()),
                    sorted((r.cluster_id, r.topic, r.ngram, round(r.weight, 6) + 0.0) for r in res["words"].collect()),
                    sorted((r.cluster_id, r.topic, r.document, round(r.loading, 5) + 0.0) for r in res["loadings"].collect())))
    assert got[0] == got[1]
    for cid, m in _dense(cdw.toPandas()).items():
        np.testing.assert_allclose([s for c, _, s in got[0][0] if c == cid], np.linalg.svd(m.to_numpy(float))[1][:2], rtol=1e-8)


def test_lsa_of_small_and_large_clusters_together(spark):
    """One run holds clusters of both kinds; a null document is one document, a cluster of one document has one topic."""
    rng = np.random.default_rng(3)
    rows = [(0, d, f"w{w:03d}", float(n)) for d in range(12) for w in range(160) if (n := rng.poisson(0.2 + (w + d) % 5 / 6))]
    rows += [(1, d, f"w{w:03d}", float(1 + (d * w) % 4)) for d in range(9) for w in range(6)]
    rows += [(1, None, "w001", 2.0), (1, None, "w005", 1.0), (2, 5, "w001", 2.0), (2, 5, "w002", 3.0)]
    cdw = spark.createDataFrame(rows, "cluster_id bigint, document bigint, ngram string, cnt double")
    words = cdw.select("ngram", "cluster_id").distinct()
    assert TP.lsa_topics(words, cdw, 2)["iterations"] == 0          # 160 words: more than lsa() solves at once, fewer than the run of all clusters
    res = TP.lsa(cdw, 2)
    assert res["iterations"] > 0
    sigma = {(r.cluster_id, r.topic): r.sigma for r in res["singular"].collect()}
    pdf = cdw.toPandas()
    for cid, m in _dense(pdf.assign(document=pdf["document"].fillna(-1))).items():
        want = [*np.linalg.svd(m.to_numpy(float))[1], 0.0][:2]
        np.testing.assert_allclose([sigma[cid, 1], sigma[cid, 2]], want, rtol=1e-8, atol=1e-9)
    assert res["loadings"].where("cluster_id = 1 AND document IS NULL").count() == 2
    assert res["loadings"].count() == 2 * (12 + 10 + 1)
