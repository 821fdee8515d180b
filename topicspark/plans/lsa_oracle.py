"""DuckDB oracle SQL for the LSA queries: the small Gram matrix of every
cluster is squared until one direction is left, read off, deflated, repeated."""

from __future__ import annotations

from topicspark.plans.cluster_oracle import HIER
from topicspark.plans.oracle import ORACLE
from topicspark.plans.topic_oracle import CDW, CDW_OF

SQUARINGS = 16


def _vector(n: int) -> list[str]:
    """Direction ``v{n}`` and eigenvalue ``l{n}`` of ``g{n}``, and the deflated ``g{n + 1}``."""
    parts = [f"s{n}_0 AS MATERIALIZED (SELECT c, i, j, g / max(abs(g)) OVER (PARTITION BY c) AS x FROM g{n})"]
    for k in range(SQUARINGS):
        parts.append(
            f"s{n}_{k + 1} AS MATERIALIZED (SELECT c, i, j, x / max(abs(x)) OVER (PARTITION BY c) AS x FROM ("
            f"SELECT a.c, a.i, b.j, sum(a.x * b.x) AS x FROM s{n}_{k} a JOIN s{n}_{k} b ON b.c = a.c AND b.i = a.j "
            "GROUP BY 1, 2, 3))")
    last = f"s{n}_{SQUARINGS}"
    parts += [
        f"p{n} AS (SELECT c, i AS p FROM (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY x DESC, i) AS r "
        f"FROM {last} WHERE i = j) WHERE r = 1)",
        f"u{n} AS MATERIALIZED (SELECT m.c, m.i, m.x / sqrt(sum(m.x * m.x) OVER (PARTITION BY m.c)) AS v FROM {last} m "
        f"JOIN p{n} ON p{n}.c = m.c AND p{n}.p = m.j)",
        f"f{n} AS (SELECT c, CASE WHEN v < 0 THEN -1 ELSE 1 END AS sgn FROM (SELECT c, v, row_number() OVER "
        f"(PARTITION BY c ORDER BY round(abs(v), 9) DESC, i) AS r FROM u{n}) WHERE r = 1)",
        f"v{n} AS MATERIALIZED (SELECT u.c, u.i, u.v * f.sgn AS v FROM u{n} u JOIN f{n} f ON f.c = u.c)",
        f"l{n} AS MATERIALIZED (SELECT g.c, greatest(sum(a.v * g.g * b.v), 0) AS l FROM g{n} g JOIN v{n} a ON a.c = g.c "
        f"AND a.i = g.i JOIN v{n} b ON b.c = g.c AND b.i = g.j GROUP BY g.c)",
        f"g{n + 1} AS MATERIALIZED (SELECT g.c, g.i, g.j, g.g - l.l * a.v * b.v AS g FROM g{n} g JOIN l{n} l ON l.c = g.c "
        f"JOIN v{n} a ON a.c = g.c AND a.i = g.i JOIN v{n} b ON b.c = g.c AND b.i = g.j)",
    ]
    return parts


PARTS = [
    "big AS (SELECT cluster_id FROM wc GROUP BY 1 HAVING count(*) >= 5)",
    "used AS (SELECT cluster_id FROM cdw GROUP BY 1 HAVING count(DISTINCT document) >= 2 AND count(DISTINCT ngram) >= 2)",
    "a AS MATERIALIZED (SELECT cluster_id AS c, document AS d, ngram AS w, CAST(cnt AS DOUBLE) AS x FROM cdw "
    "WHERE cluster_id IN (SELECT cluster_id FROM big) AND cluster_id IN (SELECT cluster_id FROM used))",
    "ws AS (SELECT DISTINCT c, w FROM a)",
    "g1 AS MATERIALIZED (SELECT p.c, p.w AS i, q.w AS j, coalesce(z.g, 0) AS g FROM ws p JOIN ws q ON q.c = p.c LEFT JOIN "
    "(SELECT s.c, s.w AS i, t.w AS j, sum(s.x * t.x) AS g FROM a s JOIN a t ON t.c = s.c AND t.d = s.d GROUP BY 1, 2, 3) z "
    "ON z.c = p.c AND z.i = p.w AND z.j = q.w)",
    *_vector(1), *_vector(2),
    "vec AS (SELECT c, 1 AS topic, i AS w, v FROM v1 UNION ALL SELECT c, 2, i, v FROM v2)",
    "sig AS (SELECT c, 1 AS topic, sqrt(l) AS s FROM l1 UNION ALL SELECT c, 2, sqrt(l) FROM l2)",
    "load AS (SELECT a.c, vec.topic, a.d, sum(a.x * vec.v) AS y FROM a JOIN vec ON vec.c = a.c AND vec.w = a.w GROUP BY 1, 2, 3)",
    "imp AS (SELECT load.c, load.topic, sum(abs(load.y)) * any_value(sig.s) AS m FROM load JOIN sig ON sig.c = load.c "
    "AND sig.topic = load.topic GROUP BY 1, 2)",
]
FIT = ", ".join([CDW, *PARTS])

SINGULAR = (
    "SELECT c AS cluster_id, round(max(s) FILTER (topic = 1), 4) AS leading_singular, "
    "round(max(s) FILTER (topic = 2), 4) AS second_singular, true AS converged FROM sig GROUP BY c"
)
ORACLE["lsa_singular_values"] = f"{FIT} {SINGULAR}"
ORACLE["lsa_singular_values_hier"] = f"{', '.join([CDW_OF.format(seq=HIER), *PARTS])} {SINGULAR}"
ORACLE["lsa_importance"] = (
    f"{FIT} SELECT c AS cluster_id, round(max(m) FILTER (topic = 1), 2) AS leading_importance, "
    "round(max(m) FILTER (topic = 2), 2) AS second_importance, true AS converged FROM imp GROUP BY c"
)
ORACLE["lsa_topic_words"] = (
    f"{FIT} SELECT c AS cluster_id, topic, w AS ngram, round(v, 4) AS weight, CAST(row_number() OVER "
    "(PARTITION BY c, topic ORDER BY round(v, 9) DESC, w) AS INTEGER) AS rnk, true AS converged FROM vec"
)
ORACLE["lsa_doc_loading"] = f"{FIT} SELECT c AS cluster_id, topic, d AS document, round(y, 4) AS loading, true AS converged FROM load"
ORACLE["lsa_document_topics"] = (
    f"{FIT} SELECT d AS document, CAST(count(*) AS INTEGER) AS n_topics, string_agg(c || ':' || CAST(round(y * 100) AS BIGINT), ' ' ORDER BY c) AS loadings "
    "FROM load WHERE topic = 1 GROUP BY d"
)
