"""DuckDB oracle SQL for the clustering queries.

The greedy procedures are checked against an independent *sequential*
evaluation: a recursive CTE walks the points in visiting order, carrying the
claimed list, exactly like the reference loop.
"""

from __future__ import annotations

from topicspark.plans.oracle import CLEAN_COUNTS_CTES, ORACLE
from topicspark.plans.vector_oracle import SIMS, UNIT, ham_cte, sig_ctes

EXACT_LISTS = (
    "nb AS (SELECT q, list(n ORDER BY rnk) AS lst FROM (SELECT q, n, row_number() OVER "
    "(PARTITION BY q ORDER BY (q = n) DESC, sim DESC, n) AS rnk FROM sims) WHERE rnk <= 50 GROUP BY q)"
)
LSH_LISTS = (
    f"{sig_ctes(32)}, {ham_cte('ham')}, "
    "hr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY (q = n) DESC, hamming, n) AS rnk FROM ham), "
    "top AS (SELECT hr.q, hr.n, hr.rnk, list_dot_product(a.v, b.v) AS sim FROM hr "
    "JOIN unit a ON a.vec_id = hr.q JOIN unit b ON b.vec_id = hr.n WHERE hr.rnk <= 50), "
    "stop AS (SELECT q, min(rnk) AS s FROM top WHERE sim < 0.3 AND q <> n GROUP BY q), "
    "kept AS (SELECT top.* FROM top LEFT JOIN stop ON top.q = stop.q "
    "WHERE stop.s IS NULL OR top.rnk < stop.s OR top.q = top.n), "
    "nb AS (SELECT q, list(n ORDER BY rnk) AS lst FROM kept GROUP BY q)"
)
NEAREST_LISTS = (
    "nn AS (SELECT q, n, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, n) AS rk "
    "FROM sims WHERE q <> n) WHERE rk = 1), "
    "nb AS (SELECT u.vec_id AS q, CASE WHEN nn.sim > 0.3 THEN [u.vec_id, nn.n] ELSE [u.vec_id] END AS lst "
    "FROM unit u LEFT JOIN nn ON nn.q = u.vec_id)"
)
ORDER_BY_ID = "ord AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS step FROM unit)"
SEED_LIST = "[7, 3, 400, 123]"
ORDER_SEEDED = (
    f"ord AS (SELECT vec_id, row_number() OVER (ORDER BY coalesce(list_position({SEED_LIST}, vec_id), 0) = 0, "
    f"coalesce(list_position({SEED_LIST}, vec_id), 0), vec_id) - 1 AS step FROM unit)"
)
WALK = (
    "steps AS MATERIALIZED (SELECT o.step, o.vec_id, nb.lst FROM ord o JOIN nb ON nb.q = o.vec_id), "
    "walk(step, claimed, members) AS ("
    "SELECT -1, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL "
    "SELECT s.step, CASE WHEN list_contains(w.claimed, s.vec_id) THEN w.claimed ELSE "
    "list_concat(w.claimed, list_filter(s.lst, lambda x: NOT list_contains(w.claimed, x))) END, "
    "CASE WHEN list_contains(w.claimed, s.vec_id) THEN CAST([] AS BIGINT[]) ELSE "
    "list_filter(s.lst, lambda x: NOT list_contains(w.claimed, x)) END "
    "FROM walk w JOIN steps s ON s.step = w.step + 1), "
    "heads AS (SELECT step, members, row_number() OVER (ORDER BY step) - 1 AS cluster_id "
    "FROM walk WHERE len(members) > 0), "
    "seq AS (SELECT unnest(members) AS vec_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM heads)"
)


def walk_sql(lists: str, order: str) -> str:
    return f"WITH RECURSIVE {UNIT}, {SIMS}, {lists}, {order}, {WALK}"


SEQ = walk_sql(EXACT_LISTS, ORDER_BY_ID)
WORDS = (
    "vocab_rank AS (SELECT word AS ngram, row_number() OVER (ORDER BY total DESC, word) - 1 AS word_rank "
    "FROM (SELECT word, sum(cnt) AS total FROM clean_counts GROUP BY word)), "
    "words AS (SELECT u.vec_id, v.ngram FROM unit u JOIN vocab_rank v ON v.word_rank = u.vec_id), "
    "wc AS (SELECT words.ngram, seq.cluster_id FROM seq JOIN words ON words.vec_id = seq.vec_id)"
)

ORACLE["seq_cluster"] = f"{SEQ} SELECT vec_id, cluster_id FROM seq"
ORACLE["seq_cluster_lsh"] = f"{walk_sql(LSH_LISTS, ORDER_BY_ID)} SELECT vec_id, cluster_id FROM seq"
ORACLE["seeded_cluster"] = f"{walk_sql(EXACT_LISTS, ORDER_SEEDED)} SELECT vec_id, cluster_id FROM seq"
ORACLE["hier_round"] = f"{walk_sql(NEAREST_LISTS, ORDER_BY_ID)} SELECT vec_id, cluster_id FROM seq"
HIER_ROUNDS = 14


def hier_sql(hash_above: int | None = None, bits: int = 0) -> str:
    """C5 with its rounds unrolled; a round after the end repeats its input.
    ``seq`` holds the members at the end."""
    parts = [f"WITH RECURSIVE {UNIT}", "m0 AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS c FROM unit)"]
    if bits:
        parts.append(f"planes AS (SELECT j, list(CASE WHEN substr(md5('42:' || j || ':' || i), 1, 1) < '8' THEN 1.0 ELSE -1.0 END ORDER BY i) AS pl "
                     f"FROM range({bits}) a(j), range(64) b(i) GROUP BY j)")
    for r in range(HIER_ROUNDS):
        before = "" if r == 0 else f" AND (SELECT go FROM ok{r - 1}) AND (SELECT n FROM s{r - 1}) - (SELECT n FROM s{r}) >= 10"
        parts += [
            f"s{r} AS MATERIALIZED (SELECT count(DISTINCT c) AS n FROM m{r})",
            f"ok{r} AS MATERIALIZED (SELECT (SELECT n FROM s{r}) > 20{before} AS go)",
            f"e{r} AS (SELECT m.c, i, avg(x) AS x FROM (SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x FROM unit) u "
            f"JOIN m{r} m ON m.vec_id = u.vec_id GROUP BY m.c, i)",
            f"c{r} AS MATERIALIZED (SELECT c, list(x / l ORDER BY i) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY c)) AS l FROM e{r}) GROUP BY c)",
        ]
        order = "sim DESC, n"
        hashed = ""
        if bits:
            parts.append(f"b{r} AS MATERIALIZED (SELECT c, list(list_dot_product(v, pl) >= 0 ORDER BY j) AS h FROM c{r}, planes GROUP BY c)")
            hashed = (f", (SELECT len(list_filter(list_zip(p.h, q.h), lambda z: z[1] <> z[2])) FROM b{r} p, b{r} q WHERE p.c = a.c AND q.c = b.c) AS ham")
            order = f"CASE WHEN (SELECT n FROM s{r}) > {hash_above} THEN ham ELSE 0 END, CASE WHEN (SELECT n FROM s{r}) > {hash_above} THEN 0 ELSE -sim END, n"
        parts += [
            f"nn{r} AS (SELECT q, n, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {order}) AS rk FROM "
            f"(SELECT a.c AS q, b.c AS n, list_dot_product(a.v, b.v) AS sim{hashed} FROM c{r} a JOIN c{r} b ON a.c <> b.c)) WHERE rk = 1)",
            f"t{r} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY c.c) - 1 AS step, c.c, CASE WHEN n.sim > 0.3 THEN [c.c, n.n] ELSE [c.c] END AS lst "
            f"FROM (SELECT DISTINCT c FROM m{r}) c LEFT JOIN nn{r} n ON n.q = c.c)",
            f"w{r}(step, claimed, got) AS (SELECT -1, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL "
            f"SELECT s.step, CASE WHEN list_contains(w.claimed, s.c) THEN w.claimed ELSE list_concat(w.claimed, list_filter(s.lst, lambda x: NOT list_contains(w.claimed, x))) END, "
            f"CASE WHEN list_contains(w.claimed, s.c) THEN CAST([] AS BIGINT[]) ELSE list_filter(s.lst, lambda x: NOT list_contains(w.claimed, x)) END "
            f"FROM w{r} w JOIN t{r} s ON s.step = w.step + 1 WHERE (SELECT go FROM ok{r}))",
            f"h{r} AS (SELECT unnest(got) AS c, k FROM (SELECT got, row_number() OVER (ORDER BY step) - 1 AS k FROM w{r} WHERE len(got) > 0))",
            f"m{r + 1} AS MATERIALIZED (SELECT m.vec_id, CASE WHEN (SELECT go FROM ok{r}) THEN h.k ELSE m.c END AS c FROM m{r} m LEFT JOIN h{r} h ON h.c = m.c)",
        ]
    parts.append(f"seq AS (SELECT vec_id, CAST(c AS BIGINT) AS cluster_id FROM m{HIER_ROUNDS})")
    return ", ".join(parts)


HIER = hier_sql()
ORACLE["hier_cluster"] = f"{HIER} SELECT vec_id, cluster_id FROM seq"
ORACLE["hier_cluster_lsh"] = f"{hier_sql(100, 256)} SELECT vec_id, cluster_id FROM seq"
ORACLE["hier_cluster_words"] = (
    f"{HIER}, {CLEAN_COUNTS_CTES}, {WORDS} SELECT cluster_id, (r - 1) // 20 AS piece, count(*) AS n_words, string_agg(ngram, ' ' ORDER BY ngram) AS words "
    "FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ngram) AS r FROM wc) GROUP BY 1, 2"
)
TUNED_LISTS = (
    f"tuned AS MATERIALIZED (SELECT nbits FROM ({ORACLE['lsh_tuning']}) WHERE chosen), {sig_ctes(2048)}, "
    f"{ham_cte('ham', '(SELECT nbits // 32 FROM tuned)')}, " + LSH_LISTS.split(f"{ham_cte('ham')}, ")[1]
)
ORACLE["seq_cluster_tuned"] = f"{walk_sql(TUNED_LISTS, ORDER_BY_ID)} SELECT vec_id, cluster_id FROM seq"
ORACLE["centroids"] = (
    f"{SEQ}, elems AS (SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS i, unnest(v) AS x FROM unit), "
    "cent AS (SELECT s.cluster_id, e.i AS dim, avg(e.x) AS x FROM seq s JOIN elems e ON e.vec_id = s.vec_id "
    "GROUP BY 1, 2), cn AS (SELECT cluster_id, sqrt(sum(x * x)) AS nrm FROM cent GROUP BY 1) "
    "SELECT c.cluster_id, CAST(c.dim AS INTEGER) AS dim, round(c.x / cn.nrm, 6) AS value "
    "FROM cent c JOIN cn ON c.cluster_id = cn.cluster_id"
)
ORACLE["word_cluster"] = f"{SEQ}, {CLEAN_COUNTS_CTES}, {WORDS} SELECT ngram, cluster_id FROM wc"
ORACLE["cluster_words"] = (
    f"{SEQ}, {CLEAN_COUNTS_CTES}, {WORDS} SELECT cluster_id, count(*) AS n_words, "
    "string_agg(ngram, ' ' ORDER BY ngram) AS words FROM wc GROUP BY cluster_id"
)
