"""DuckDB oracle SQL for the registered queries.

Written independently of the Spark code from the operator definitions.  RE2
has no Unicode mode for \\w, so the cleaning class is spelled with Unicode
properties.  The fixed values (stop words, contraction splits, suffix rules)
are rendered from the same constants module.
"""

from __future__ import annotations

from topicspark.functions.constants import (
    CONTRACTION_SPLITS,
    ENGLISH_STOP_WORDS,
    NOUN_SUFFIX_RULES,
    WHITESPACE_CLASS,
)

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = "(" + ", ".join(_q(w) for w in ENGLISH_STOP_WORDS) + ")"
WS = WHITESPACE_CLASS.replace("{", "{{").replace("}", "}}")
SPLIT = f"list_filter(regexp_split_to_array(lower({{c}}), '[{WS}]+'), lambda x: x <> '')"
CLEAN = f"regexp_replace({{c}}, '\\p{{{{Nd}}}}|[^\\p{{{{L}}}}\\p{{{{N}}}}_{WS}]', ' ', 'g')"
CONTRACT = ("flatten(list_transform({a}, lambda x: CASE x "
            + " ".join(f"WHEN {_q(w)} THEN [{', '.join(_q(p) for p in parts)}]" for w, parts in CONTRACTION_SPLITS)
            + " ELSE [x] END))")
DOC_DATE = "(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER))"


def _unnest(list_sql: str, id_col: str = "doc_id") -> str:
    return (f"SELECT {id_col}, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS pos, "
            f"unnest(toks) AS token FROM (SELECT {id_col}, {list_sql} AS toks FROM documents)")


WS_TOKENS = _unnest(SPLIT.format(c="text"))
CLEAN_TOKENS = _unnest(CONTRACT.format(a=SPLIT.format(c=CLEAN.format(c="text"))))
CLEAN_NOSTOP = f"SELECT * FROM ({CLEAN_TOKENS}) WHERE token NOT IN {STOP_LIST}"


def _lemma_cte(vocab_sql: str) -> str:
    """``lemma(word, lemma)`` over the words of ``vocab_sql`` (lexicon = same words)."""
    parts = [f"SELECT word, {len(NOUN_SUFFIX_RULES) + 1} AS prio, word AS cand FROM vocab"]
    for i, (suf, rep) in enumerate(NOUN_SUFFIX_RULES, start=1):
        parts.append(f"SELECT word, {i} AS prio, left(word, length(word) - {len(suf)}) || {_q(rep)} AS cand "
                     f"FROM vocab WHERE ends_with(word, {_q(suf)})")
    cands = " UNION ALL ".join(parts)
    return (f"vocab AS (SELECT DISTINCT word FROM ({vocab_sql})), "
            f"cands AS ({cands}), "
            f"hits AS (SELECT * FROM cands WHERE cand <> '' AND cand IN (SELECT word FROM vocab)), "
            f"lemma AS (SELECT word, cand AS lemma FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY word ORDER BY length(cand), prio) AS rn FROM hits) WHERE rn = 1)")


LEMMA_CTES = _lemma_cte(f"SELECT token AS word FROM ({CLEAN_NOSTOP})")
# cleaned per-document counts: lemmatised non-stop tokens, stop lemmas dropped
CLEAN_COUNTS_CTES = (
    f"{LEMMA_CTES}, "
    f"lt AS (SELECT t.doc_id, t.pos, coalesce(l.lemma, t.token) AS token FROM ({CLEAN_NOSTOP}) t "
    f"LEFT JOIN lemma l ON t.token = l.word), "
    f"clean_counts AS (SELECT doc_id, token AS word, count(*) AS cnt FROM lt "
    f"WHERE token NOT IN {STOP_LIST} GROUP BY doc_id, token)"
)

ORACLE["tok_whitespace"] = WS_TOKENS
ORACLE["tok_nostop"] = f"SELECT * FROM ({WS_TOKENS}) WHERE token NOT IN {STOP_LIST}"
ORACLE["word_freq_doc"] = (f"SELECT doc_id, token AS word, count(*) AS cnt FROM ({WS_TOKENS}) "
                           f"WHERE token NOT IN {STOP_LIST} GROUP BY doc_id, token")
ORACLE["strip_chars"] = f"SELECT doc_id, {CLEAN.format(c='text')} AS text FROM documents"
ORACLE["tok_clean"] = CLEAN_TOKENS
ORACLE["lemma_map"] = f"WITH {LEMMA_CTES} SELECT word, lemma FROM lemma"
ORACLE["lemma_tokens"] = f"WITH {CLEAN_COUNTS_CTES} SELECT doc_id, pos, token FROM lt"
ORACLE["clean_text"] = (
    f"WITH {CLEAN_COUNTS_CTES}, "
    f"j AS (SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM lt GROUP BY doc_id) "
    f"SELECT d.doc_id, coalesce(j.text, '') AS text FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id"
)
ORACLE["daily_word_freq"] = (
    f"SELECT {DOC_DATE} AS date, token AS word, count(*) AS word_freq FROM ({WS_TOKENS}) "
    f"WHERE token NOT IN {STOP_LIST} GROUP BY 1, 2"
)
ORACLE["daily_word_long"] = (
    f"WITH {CLEAN_COUNTS_CTES} SELECT {DOC_DATE} AS date, word AS word_id, "
    f"CAST(sum(cnt) AS BIGINT) AS word_freq FROM clean_counts GROUP BY 1, 2"
)
ORACLE["tf_idf"] = (
    f"WITH {CLEAN_COUNTS_CTES}, "
    f"dfreq AS (SELECT word, count(DISTINCT doc_id) AS df FROM clean_counts GROUP BY word), "
    f"n AS (SELECT count(DISTINCT doc_id) AS n_docs FROM clean_counts) "
    f"SELECT c.doc_id, c.word, c.cnt AS tf, d.df, "
    f"round(c.cnt * ln((1 + n.n_docs) / (1 + d.df)), 6) AS tf_idf "
    f"FROM clean_counts c JOIN dfreq d ON c.word = d.word, n"
)

ORACLE["daily_bag_long"] = f"SELECT date, word AS word_id, word_freq FROM ({ORACLE['daily_word_freq']})"

# the stream sums up to the batch result
ORACLE["stream_daily_word_freq"] = ORACLE["daily_word_freq"]


def oracle_sql() -> dict[str, str]:
    # later modules add their SQL on import
    from topicspark.plans import cluster_oracle, lda_oracle, lsa_oracle, topic_oracle, vector_oracle  # noqa: F401
    return dict(ORACLE)
