"""DuckDB oracle SQL for the L1 topic queries and reports."""

from __future__ import annotations

from topicspark.plans.cluster_oracle import EXACT_LISTS, HIER, ORDER_SEEDED, SEQ, WORDS, walk_sql
from topicspark.plans.oracle import CLEAN_COUNTS_CTES, ORACLE

CDW_OF = (
    "{seq}, " + f"{CLEAN_COUNTS_CTES}, {WORDS}, ".replace("{", "{{").replace("}", "}}") +
    "cdw AS (SELECT wc.cluster_id, c.doc_id AS document, c.word AS ngram, CAST(sum(c.cnt) AS BIGINT) AS cnt "
    "FROM clean_counts c JOIN wc ON wc.ngram = c.word GROUP BY 1, 2, 3), "
    "tw AS (SELECT cluster_id, ngram, sum(cnt) AS cnt FROM cdw GROUP BY 1, 2), "
    "tot AS (SELECT cluster_id, sum(cnt) AS total FROM tw GROUP BY 1), "
    "shares AS (SELECT tw.cluster_id, tw.ngram, CAST(tw.cnt AS BIGINT) AS cnt, tw.cnt / tot.total AS weight "
    "FROM tw JOIN tot ON tw.cluster_id = tot.cluster_id)"
)
CDW = CDW_OF.format(seq=SEQ)
SEEDED = walk_sql(EXACT_LISTS, ORDER_SEEDED)

ORACLE["word_cluster_table"] = (
    f"SELECT s.ngram, s.cluster_id AS sequential_cluster, d.cluster_id AS seeded_cluster "
    f"FROM ({SEQ}, {CLEAN_COUNTS_CTES}, {WORDS} SELECT ngram, cluster_id FROM wc) s "
    f"JOIN ({SEEDED}, {CLEAN_COUNTS_CTES}, {WORDS} SELECT ngram, cluster_id FROM wc) d ON d.ngram = s.ngram"
)
ORACLE["l1_importance_seeded"] = (
    f"{CDW_OF.format(seq=SEEDED)} SELECT cluster_id, CAST(sum(cnt) AS BIGINT) AS total, "
    "round(sum(weight), 6) AS share_sum FROM shares GROUP BY 1"
)

ORACLE["l1_importance_hier"] = (
    f"{CDW_OF.format(seq=HIER)} SELECT cluster_id, CAST(sum(cnt) AS BIGINT) AS total, "
    "round(sum(weight), 6) AS share_sum FROM shares GROUP BY 1"
)

ORACLE["cluster_doc_word"] = f"{CDW} SELECT cluster_id, document, ngram, cnt FROM cdw"
ORACLE["l1_doc_loading"] = (
    f"{CDW} SELECT cluster_id, document, CAST(sum(cnt) AS BIGINT) AS loading FROM cdw GROUP BY 1, 2"
)
ORACLE["l1_topic_words"] = f"{CDW} SELECT cluster_id, ngram, cnt, round(weight, 6) AS weight FROM shares"
ORACLE["l1_importance"] = (
    f"{CDW} SELECT cluster_id, CAST(sum(cnt) AS BIGINT) AS total, round(sum(weight), 6) AS share_sum "
    "FROM shares GROUP BY 1"
)
ORACLE["topic_words_table"] = (
    f"{CDW} SELECT cluster_id AS topic, ngram, round(weight, 6) AS weight, CAST(row_number() OVER "
    "(PARTITION BY cluster_id ORDER BY weight DESC, ngram) AS INTEGER) AS rnk FROM shares"
)
ORACLE["lsa_cluster_status"] = (
    f"{CDW}, sizes AS (SELECT cluster_id, count(*) AS n_words FROM wc GROUP BY 1), "
    "used AS (SELECT cluster_id, count(DISTINCT document) AS n_docs, count(DISTINCT ngram) AS n_used_words "
    "FROM cdw GROUP BY 1) "
    "SELECT s.cluster_id, s.n_words, coalesce(u.n_docs, 0) AS n_docs, coalesce(u.n_used_words, 0) AS n_used_words, "
    "CASE WHEN s.n_words < 5 THEN 'too_small' WHEN coalesce(u.n_docs, 0) = 0 THEN 'no_documents' "
    "WHEN coalesce(u.n_docs, 0) < 2 OR coalesce(u.n_used_words, 0) < 2 THEN 'rank_lt_n' ELSE 'ok' END AS status "
    "FROM sizes s LEFT JOIN used u ON s.cluster_id = u.cluster_id"
)
ORACLE["doc_topic_wide"] = (
    f"{CDW}, l1 AS (SELECT cluster_id, document, CAST(sum(cnt) AS BIGINT) AS loading FROM cdw GROUP BY 1, 2) "
    "SELECT document, CAST(count(*) AS INTEGER) AS n_topics, "
    "string_agg(cluster_id || ':' || loading, ' ' ORDER BY cluster_id) AS loadings FROM l1 GROUP BY document"
)
ORACLE["lda_input"] = (
    f"{SEQ}, {CLEAN_COUNTS_CTES}, {WORDS} SELECT wc.cluster_id, c.doc_id AS document, c.word AS ngram, "
    "CAST(floor(avg(c.cnt)) AS BIGINT) AS cnt FROM clean_counts c JOIN wc ON wc.ngram = c.word "
    "GROUP BY 1, 2, 3 HAVING floor(avg(c.cnt)) > 0"
)
