"""Operators 11 to 13 against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from topicspark.llm import spelling, topk_search, vector_codes

VECTORS = "vec_id bigint, embedding array<double>, label int, idx int, score double, vec string"


# ------------------------------------------------------------------ 11

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def brute_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)
    return out


def spelled(df, **kw):
    got = spelling.variants(df, **kw).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def spelling_rows():
    rng = np.random.default_rng(5)
    stems = ["zurücklegen", "Abstand", "abstandd", "weather", "whether", "wheather", "anderen", "colour" * 3, "aaaaaaa", "aaaaaaaa", "élèvesé"]
    rows = []
    for i in range(400):
        words = list(rng.choice(stems, 12, p=[.02, .3, .02, .3, .02, .01, .3, .01, .005, .005, .01]))
        if i % 3 == 0:
            w = words[0]
            at, c = rng.integers(len(w)), chr(97 + rng.integers(26))
            words[0] = [w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]][i % 9 // 3]
        rows.append((i, " ".join(words)))
    return rows


def test_spelling_against_brute_force(spark, edge, empty):
    rows = spelling_rows() + [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = brute_variants(rows)
    assert spelled(df) == want and sum(v[0] is not None for v in want.values()) > 5
    assert spelled(df, filter_bits=1 << 10) == want                # a full bit table decides nothing
    assert spelled(df, symbols=2) == want and spelled(df, symbols=26) == want
    edges = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert spelled(edge) == brute_variants(edges)                  # extra columns with clashing names
    assert spelled(empty) == {}


def test_spelling_follows_forms_to_the_root(spark):
    rows = [(1, "laterally " * 2000), (2, "lateraly " * 150), (3, "latraly " * 12), (4, "latrally " * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_variants(rows)
    assert spelled(df) == want
    assert {v[1] for v in want.values()} == {"laterally"}


def test_spelling_of_a_very_long_text(spark):
    text = ("Zusammenhang zusammenhange, zusamenhang! " * 40000) + "q" * 300000 + " " + "q" * 300000
    rows = [(7, text), (8, "q" * 300001 + " " + "q" * 300001)]
    got = spelled(spark.createDataFrame(rows, "doc_id bigint, text string"))
    n = Counter(re.findall("[a-z]+", text.lower()) + ["q" * 300001] * 2)
    assert all(zlib.crc32(f"{7 if len(w) != 300001 else 8}:{w}".encode()) % 31 for w in n)     # no letter goes
    assert {w: v[2] for w, v in got.items()} == dict(n)
    assert got["q" * 300000][3] == got["q" * 300001][3] == 1


def test_one_edit_by_halving():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("ab"), n)) for n in rng.integers(0, 7, 300)]
    for a, b in zip(words, words[1:] + words[:1]):
        assert spelling.one_edit(a, b) == one_edit(a, b), (a, b)


def test_spelling_stretches_cut_no_run():
    text = "abc defghijékl mnop" * 50 + "x" * 100
    for size in (1, 7, 64):
        parts = list(spelling.stretches(text, size))
        assert "".join(parts) == text
        assert [w for p in parts for w in re.findall("[A-Za-zÀ-ÿ]+", p)] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_spelling_neighbourhood_is_whole():
    rng = np.random.default_rng(2)
    for length in (1, 2, 5):
        s = rng.integers(1, 4, (3, length)).astype(np.uint64)
        got = {}
        for row, code in spelling.neighbourhood(s, 3):
            for r, c in zip(row.tolist(), code.tolist()):
                got.setdefault(r, []).append(c)
        for r, word in enumerate(s.tolist()):
            around = {tuple(word[:i] + word[i + 1:]) for i in range(length)}
            around |= {tuple(word[:i] + [c] + word[i + 1:]) for i in range(length) for c in (1, 2, 3)}
            around |= {tuple(word[:i] + [c] + word[i:]) for i in range(length + 1) for c in (1, 2, 3)}
            around -= {tuple(word)}
            want = {int(spelling.codes(np.array([w], np.uint64).reshape(1, -1))[0]) for w in around}
            assert set(got[r]) == want and len(got[r]) == len(want)


# ------------------------------------------------------------------ 12

def good(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_top(rows, k, every, scale=64):
    width = max((len(r[1]) for r in rows if good(r[1])), default=0)
    kept = [(i, [int(np.floor(scale * x)) for x in v] + [0] * (width - len(v))) for i, v in rows if good(v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        scored = sorted((-sum(p * r for p, r in zip(x, y)), c is None, c or 0) for b, (c, y) in enumerate(kept) if b != a)
        out += [(q, i + 1, None if none else c, -s) for i, (s, none, c) in enumerate(scored[:k])]
    return sorted(out, key=repr)


def vector_rows(n=600, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) * rng.gamma(2.0, 1.0, (n, 1)) * (0.5 ** np.arange(dim))
    x[100:300] = x[0]                                             # a third are copies
    x[300:330] = 0
    rows = [(i, [float(v) for v in row], i % 7 if i % 5 else None) for i, row in enumerate(x)]
    return rows + [(20, rows[3][1], 1), (20, rows[3][1], 1), (40, None, 1), (60, [None, 1.0], 2), (80, [float("nan")] * dim, 2),
                   (100000, [], 3), (100020, [1.0, 2.0], 3), (None, rows[5][1], None), (None, rows[5][1], 9), (-40, [float("inf")], 0),
                   (-20, rows[8][1], None)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], VECTORS).repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"head": 32, "query_block": 4, "stripe": 100}])
def test_topk_against_brute_force(spark, sizes):
    rows = vector_rows()
    got = topk_search.top_k(frame(spark, rows), k=9, every=20, **sizes).collect()
    want = brute_top([(i, v) for i, v, _ in rows], 9, 20)
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=repr) == want


def test_topk_few_rows_and_empty(spark):
    rows = [(0, [1.0, -2.0], 0), (20, [0.0, 0.0], 0), (7, [3.0], 1)]
    got = topk_search.top_k(frame(spark, rows)).collect()
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=repr) == brute_top([r[:2] for r in rows], 20, 20)
    assert topk_search.top_k(frame(spark, rows).limit(0)).collect() == []
    assert topk_search.top_k(frame(spark, [(20, [], 0), (40, [], 0)])).count() == 2


def test_topk_of_large_numbers_is_exact(spark):
    rows = [(i, [float(2 ** 25 + i * 3), float(-(2 ** 24) - i)], 0) for i in range(50)]
    got = topk_search.top_k(frame(spark, rows), k=5, head=8).collect()
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=repr) == brute_top([r[:2] for r in rows], 5, 20)
    with pytest.raises(Exception, match="64-bit"):
        topk_search.top_k(frame(spark, [(0, [1e300], 0)])).collect()


# ------------------------------------------------------------------ 13

def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(i, [int(np.floor(scale * x)) for x in v], lab) for i, v, lab in rows if good(v)]
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    width = -(-max(len(v) for _, v, _ in kept) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in kept]
    step = width // parts
    cut = lambda v, p: v[p * step:(p + 1) * step]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i8").tobytes()))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    nearest = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), f in zip(kept, found) if f[p] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    out, by_label = [], Counter()
    for i, v, lab in kept:
        got = [nearest(v, p) for p in range(parts)]
        out.append((i, "".join(f"{j:02x}" for _, j in got), sum(d for d, _ in got), lab))
        by_label[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab]) for i, c, e, lab in out), key=repr), digest


@pytest.mark.parametrize("rows", [vector_rows(250, 16), vector_rows(40, 11, 8), [(3, [0.5] * 8, None), (1, [0.25] * 8, None)],
                                  [(1, [], 0), (2, [], None)]])
def test_codes_against_brute_force(spark, rows):
    got, books = vector_codes.compress(frame(spark, rows))
    want, digest = brute_codes(rows)
    assert sorted(((r.id, r.code, r.error, r.label_error) for r in got.collect()), key=repr) == want
    assert vector_codes.books_sha256(books) == digest


def test_codes_of_an_empty_table(spark):
    got, books = vector_codes.compress(frame(spark, [(1, None, 0)]))
    assert got.collect() == [] and books == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_orchard_finds_the_nearest_entry(kind):
    rng = np.random.default_rng(9)
    for spread in (3, 50, 4000):                                   # many ties, few, none
        points, entries = rng.integers(-spread, spread, (500, 4)).astype(kind), rng.integers(-spread, spread, (16, 4)).astype(kind)
        entries[7] = entries[2]
        d = ((points[:, None, :] - entries[None]) ** 2).sum(2)
        index, dist = vector_codes.orchard(points, entries)
        assert (index == np.array([min(range(16), key=lambda j: (row[j], j)) for row in d])).all()
        assert (dist == d.min(1)).all()
