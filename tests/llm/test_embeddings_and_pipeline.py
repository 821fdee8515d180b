"""Operator 6 and the pipeline."""

import numpy as np
import __spark_entry__ as entry
import corpus_pipeline
from test_text_operators import brute_components, brute_cut
from topicspark.llm import embedding_dedup
from topicspark.llm.components import components
from topicspark.llm.queries import QUERIES
from topicspark.session import checkpoint

SF, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute_links(x, threshold=0.95):
    x = x / np.sqrt((x * x).sum(1))[:, None]
    hit = x @ x.T >= threshold
    np.fill_diagonal(hit, False)
    comp = np.arange(len(x))
    while True:
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(len(x))])
        if (new == comp).all():
            return hit.sum(1), comp
        comp = new


def test_embedding_query_recall(spark):
    got = QUERIES["op6_embedding_dedup"](spark, SF).toPandas().sort_values("vec_id")
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    links, comp = brute_links(np.stack(raw.embedding).astype(float))
    assert (got.n_links.to_numpy() <= links).all() and got.n_links.sum() >= 0.9 * links.sum()
    assert (got.component_id.to_numpy() == raw.vec_id.to_numpy()[comp]).mean() >= 0.9


def test_embedding_hot_group_and_edges(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    near = [base + 0.05 * rng.standard_normal(16) for _ in range(300)]
    far = [rng.standard_normal(16) for _ in range(100)]
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(near + far)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (600, None, 0), (601, [0.0] * 16, 0),
             (602, [float("nan")] + [1.0] * 15, 0), (603, [None] + [1.0] * 15, 0), (604, [1.0, 2.0], 0),
             (605, [2.0, 4.0], 0), (None, [3.0] * 7, 0), (606, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, comp int")
    got = {r.id: r for r in embedding_dedup.dedup(df, window=8, block=64).collect()}
    x = np.array([r[1] for r in rows[:402]])
    links, comp = brute_links(x)
    ids = [r[0] for r in rows[:402]]
    assert [got[i].n_links for i in ids] == links.tolist()
    assert [got[i].component_id for i in ids] == [ids[c] for c in comp]
    for i in (600, 601, 602, 603, 606):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[604].n_links == got[605].n_links == 1 and got[605].component_id == 604 and not got[605].kept
    assert len(got) == len(rows)
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(3)
    one, other = rng.standard_normal(9), rng.standard_normal(9)
    rows = [(i, [float(v) for v in x * f]) for i, (x, f) in enumerate(
        [(one, 1.0), (one, 1e200), (one, 1e-200), (one, 1e300), (other, 1e-300), (other, 1e250), (-one, 1e200)])]
    df = spark.createDataFrame(rows + [(7, [0.0] * 9), (8, None), (9, [])], "vec_id bigint, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.dedup(df).collect()}
    assert got == {**dict.fromkeys(range(4), (3, 0)), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7), 8: (0, 8), 9: (0, 9)}


def test_embedding_pairs_in_a_dense_cloud(spark):
    """A cloud just below the threshold fills the windows; its pairs must be found anyway."""
    rng = np.random.default_rng(4)
    dim, n, planted = 48, 1500, 60

    def unit(v):
        return v / np.linalg.norm(v, axis=-1, keepdims=True)

    side = unit(rng.standard_normal((n, dim)))
    side[:, 0] = 0
    side = unit(side)
    cloud = np.sqrt(0.12) * side
    cloud[:, 0] = np.sqrt(0.88)                          # mutual cosine about 0.88
    mate = unit(cloud[:planted] + 0.28 * unit(rng.standard_normal((planted, dim))))
    x = np.concatenate([cloud, mate, rng.standard_normal((500, dim))])
    links, comp = brute_links(x)
    assert (links > 0).sum() >= planted
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = embedding_dedup.dedup(df.repartition(6), window=8, block=256).toPandas().sort_values("id")
    wrong = (got.n_links.to_numpy() != links).mean() * len(x) / (links > 0).sum()
    assert wrong <= 0.02 and (got.component_id.to_numpy() != comp).sum() <= 0.02 * planted


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (250, 300)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.comp for r in components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert {got[200], got[250], got[300]} == {200}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF10}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(checkpoint(stage(spark, tables[-1], SF10)))
    assert len(names) == 5
    for t in tables[1:-1]:
        assert t.columns == columns
    toxic, lang, near, cut, packed = (t.toPandas() for t in tables[1:])
    lab = spark.read.parquet(f"{SF10}/labels.parquet").toPandas()
    clean = lab[lab.toxic == 0].doc_id
    assert clean.isin(toxic.doc_id).mean() > 0.95 and len(toxic) < docs.count()
    assert len(lang) >= 0.99 * len(toxic)
    comps = brute_components(list(zip(lang.doc_id, lang.text)))
    assert sorted(near.doc_id) == sorted({c for _, _, c in comps})
    want = brute_cut(list(zip(near.doc_id, near.text)), 100)
    after = dict(zip(cut.doc_id, cut.text))
    for (i, _), (n, removed, _, _) in want.items():
        if removed == 0:
            assert len(after[i].encode()) == n
        else:
            assert n - removed - 6 * 4 * 100 <= len(after[i].encode()) <= n - removed
    assert set(packed.doc_id) == set(cut.doc_id) and packed.groupby("bin_id")["size"].sum().max() <= 2048


def test_pipeline_on_edge_rows(spark, edge):
    out = edge
    for _, stage in corpus_pipeline.STAGES:
        before = out.columns
        out = stage(spark, out, SF)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == before
    assert out.count() > 0
    out = edge.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


def test_entry_lists_every_operator():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
