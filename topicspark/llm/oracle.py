"""DuckDB SQL of the queries that SQL can express on whole tables."""

ORACLE: dict[str, str] = {}

# operator 1: every 100-byte string by its hexadecimal digits; gaps and islands
ORACLE["op1_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents),
w AS (SELECT doc_id, unnest(generate_series(0, n - 100)) AS p, h FROM d WHERE n >= 100),
k AS (SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 200)) AS s FROM w),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM k)
          WHERE r > 1),
marked AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100
                                    OR lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL THEN 1 ELSE 0 END AS fresh
           FROM later),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z
         FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked) GROUP BY doc_id, g),
cuts AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM runs
         UNION ALL SELECT d.doc_id, coalesce(max(r.z), 0), any_value(d.n) FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id
         GROUP BY d.doc_id),
kept AS (SELECT c.doc_id, string_agg(substr(d.h, CAST(2 * c.s + 1 AS BIGINT), CAST(2 * (c.e - c.s) AS BIGINT)), '' ORDER BY c.s) AS h
         FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id),
total AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN total t ON t.doc_id = d.doc_id
"""

_REACH = """
ends AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, l.b FROM reach r JOIN ends l ON l.a = r.b),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
"""

# operator 3: shingle pairs counted directly, components by reachability
ORACLE["op3_jaccard_join"] = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id
      GROUP BY 1, 2),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 75 * (p.n + q.n - o)),
""" + _REACH + """
, many AS (SELECT a, count(*) AS n FROM ends GROUP BY a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.c, t.doc_id) AS component_id, coalesce(many.n, 0) AS n_links
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN low ON low.a = t.doc_id LEFT JOIN many ON many.a = t.doc_id
"""

# operator 6: all pairs by cosine (the query reaches them through its windows and components)
ORACLE["op6_embedding_dedup"] = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e
      WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND list_dot_product(v, v) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.vec_id < y.vec_id AND len(x.v) = len(y.v)
          WHERE list_dot_product(x.v, y.v) / (x.l * y.l) >= 0.95),
""" + _REACH + """,
c AS (SELECT a, count(*) AS n FROM ends GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, coalesce(low.c, e.vec_id) AS component_id,
       coalesce(low.c, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

# operator 11: crc32 bit by bit; words one edit apart share what is left when one letter of them goes
ORACLE["op11_spelling_variants"] = """
WITH RECURSIVE run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS k, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')) AS r FROM documents)),
pair AS (SELECT k, r, count(*) AS n FROM run WHERE length(r) >= 7 GROUP BY k, r),
bits AS (SELECT k, r, n, hex(encode(k || r)) AS x FROM pair),
crc AS (SELECT r, n, xor(list_reduce(list_concat([4294967295], flatten(list_transform(generate_series(1, length(x) // 2), lambda i:
    list_transform(generate_series(0, 7), lambda b:
      ((CAST('0x' || substr(x, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT) >> CAST(b AS BIGINT)) & 1))))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h FROM bits),
made AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) + 2 AS BIGINT)) ELSE r END AS word, n
         FROM crc),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gap AS MATERIALIZED (SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, CAST(unnest(generate_series(1, length(word))) AS BIGINT) AS i FROM w)),
near AS (SELECT DISTINCT a, b, bn FROM (
  SELECT x.word AS a, y.word AS b, y.n AS bn FROM gap x JOIN gap y ON x.rest = y.rest AND x.i = y.i WHERE x.word <> y.word
  UNION ALL SELECT g.word, w.word, w.n FROM gap g JOIN w ON g.rest = w.word
  UNION ALL SELECT w.word, g.word, g.n FROM gap g JOIN w ON g.rest = w.word)),
best AS (SELECT a, count(*) AS n_near, max(bn) AS most, arg_min(b, struct_pack(m := -bn, b := encode(b))) AS other FROM near GROUP BY a),
placed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.other END AS form,
                  CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n FROM w LEFT JOIN best b ON b.a = w.word),
walk(word, top, step) AS (SELECT word, form, 1 FROM placed WHERE form IS NOT NULL
  UNION ALL SELECT walk.word, p.form, step + 1 FROM walk JOIN placed p ON p.word = walk.top WHERE p.form IS NOT NULL),
ends AS (SELECT word, arg_max(top, step) AS root FROM walk GROUP BY word)
SELECT p.word, p.form, coalesce(e.root, p.word) AS root, p.n, p.n_near, p.form_n FROM placed p LEFT JOIN ends e ON e.word = p.word
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

# operator 12: all products
ORACLE["op12_topk_search"] = f"""
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS v FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def _codes(rounds: int = 6) -> str:
    """Operator 13: every round's assignment by all distances, each codebook a table."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
  SELECT x.vec_id, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM x JOIN b{r} b ON b.p = x.p) GROUP BY vec_id, p)"""
    mean = """b{s} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT p, e, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (
      SELECT a.p, a.e, unnest(x.v) AS c, unnest(generate_series(1, len(x.v))) AS i FROM a{r} a JOIN x ON x.vec_id = a.vec_id AND x.p = a.p)
    GROUP BY p, e, i) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [mean.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH q AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(4096 * x) AS BIGINT)) AS v
           FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS v
                   FROM (SELECT vec_id, v, unnest(generate_series(0, 7)) AS p FROM q)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x
                    WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT 16)),
{', '.join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT q.label, CAST(sum(c.error) AS BIGINT) AS label_error FROM q JOIN c ON c.vec_id = q.vec_id GROUP BY q.label),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS s FROM b{rounds})
SELECT c.vec_id, c.code, c.error, l.label_error, h.s AS codebooks_sha256
FROM c JOIN q ON q.vec_id = c.vec_id JOIN l ON l.label IS NOT DISTINCT FROM q.label, h
"""


ORACLE["op13_vector_codes"] = _codes()
