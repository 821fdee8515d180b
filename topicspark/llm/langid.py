"""Operator 5: language identification by multilingual mixture inference.

Every language has a distribution over hashed letter trigrams, counted over
all training texts.  A document is a mixture of languages: expectation
maximisation estimates its proportions from the trigram likelihoods.  Its
language set is chosen by penalised likelihood: languages are taken in order
of their proportion under the full mixture, and one more is accepted while the
log likelihood of the mixture over the larger set grows by more than
``penalty * ln(trigrams)``.  The prediction is the language of the largest
proportion within the set, its score that proportion.

The counts are aggregated by Spark as (language, trigram) rows; the table that
reaches the workers holds at most 65 536 numbers per language, and there are
at most ``max_languages`` (more raise an error).

Defined results: a text that is null or has no letter is ``und`` with score 0;
without training languages so is every text; equal texts get equal results;
null languages and null ids teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm import textio as T
from topicspark.llm.common import fresh

BITS = 16
ALPHA = 0.05
EM_STEPS = 12
PENALTY = 3.0
MAX_LANGUAGES = 512
SLICE = 1 << 20

#: letters keep their (lower-case) byte, other ASCII becomes a blank
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every byte trigram of the blank-padded rows; runs
    of blanks count once."""
    n_rows = len(offsets) - 1
    size = np.diff(offsets)
    padded = np.full(len(data) + 2 * n_rows, 32, np.uint32)
    row = np.repeat(np.arange(n_rows), size + 2)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n_rows), size) + 1] = _FOLD[data]
    blank = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (row[1:] == row[:-1]))
    s, row = padded[keep], row[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]
    inside = row[:-2] == row[2:]
    h = T.mix64(code[inside].astype(np.uint64))
    return row[:-2][inside], (h >> np.uint64(64 - BITS)).astype(np.int64)


def train(docs: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> dict:
    """Count trigrams per language over all texts that ``allowed`` (a
    condition on the column ``_id``) admits."""
    base = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                        F.col(lang_col).cast("string").alias("_lang"))
            .where(F.col("_id").isNotNull() & allowed & F.col("_text").isNotNull() & F.col("_lang").isNotNull())
            .select("_lang", "_text"))
    schema = "lang string, bucket int, cnt bigint, docs bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            data, off = T.text_bytes(batch.column(1))
            codes = batch.column(0).dictionary_encode()
            ids, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            for i, j in T.slices(off, SLICE):
                row, bucket = trigrams(data[off[i]:off[j]], off[i:j + 1] - off[i])
                who = ids[i:j][row]
                for k in np.unique(ids[i:j]):
                    got = np.bincount(bucket[who == k], minlength=1 << BITS)
                    sums[names[k]] = sums.get(names[k], 0) + got
                    rows[names[k]] = rows.get(names[k], 0) + int((ids[i:j] == k).sum())
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name] * (len(at) + 1), pa.string()),
                "bucket": pa.array(np.append(at, -1).astype(np.int32)),
                "cnt": pa.array(np.append(got[at], 0).astype(np.int64)),
                "docs": pa.array(np.append(np.zeros(len(at), np.int64), rows[name]))})

    got = base.mapInArrow(count, schema).groupBy("lang", "bucket").agg(
        F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    n_lang = base.select(F.approx_count_distinct("_lang")).first()[0]
    if n_lang > 2 * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    rows = got.toPandas()                     # at most languages x 65 537 rows
    langs = sorted(rows["lang"].unique())
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    table = np.zeros((1 << BITS, max(1, len(langs))))
    prior = np.ones(max(1, len(langs)))
    for k, name in enumerate(langs):
        mine = rows[rows["lang"] == name]
        prior[k] += mine["docs"].sum()
        mine = mine[mine["bucket"] >= 0]
        table[mine["bucket"].to_numpy(), k] = mine["cnt"]
    table = (table + ALPHA) / (table.sum(0) + ALPHA * (1 << BITS))
    return {"langs": langs, "table": table, "prior": np.log(prior / prior.sum())}


def infer(data: np.ndarray, offsets: np.ndarray, model: dict, penalty: float = PENALTY,
          steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(language index, share, set size)`` per row; index -1 without trigrams."""
    n_rows, n_lang = len(offsets) - 1, len(model["langs"])
    best, share, size = np.full(n_rows, -1), np.zeros(n_rows), np.zeros(n_rows, np.int64)
    row, bucket = trigrams(data, offsets)
    if not len(row) or not n_lang:
        return best, share, size
    key, cnt = np.unique((row << BITS) | bucket, return_counts=True)
    row, prob = key >> BITS, model["table"][key & ((1 << BITS) - 1)]
    ids, first = np.unique(row, return_index=True)
    at = np.repeat(np.arange(len(ids)), np.diff(np.append(first, len(row))))
    total = np.add.reduceat(cnt, first).astype(float)

    def em(sel: np.ndarray, allow: np.ndarray):
        """Proportions and log likelihood for the documents ``sel`` over their sets ``allow``."""
        use = np.flatnonzero(np.isin(at, sel)) if len(sel) < len(ids) else np.arange(len(at))
        d = np.searchsorted(sel, at[use])
        p, c = prob[use], cnt[use].astype(float)
        starts = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        pi = allow / allow.sum(1, keepdims=True)
        for _ in range(steps):
            mixed = np.einsum("ij,ij->i", pi[d], p)
            pi = pi * np.add.reduceat((c / mixed)[:, None] * p, starts) / total[sel][:, None]
        mixed = np.einsum("ij,ij->i", pi[d], p)
        return pi, np.add.reduceat(c * np.log(mixed), starts)

    everyone = np.arange(len(ids))
    single = np.add.reduceat(cnt[:, None] * np.log(prob), first) + model["prior"]
    top = single.argmax(1)
    pick, value, count = top.copy(), np.ones(len(ids)), np.ones(len(ids), np.int64)
    if n_lang > 1:
        full, ll_full = em(everyone, np.ones((len(ids), n_lang)))
        full[everyone, top] = 2.0                      # the best single language is always first
        order = np.argsort(-full, axis=1, kind="stable")
        cost = penalty * np.log(total + 1)
        now = single[everyone, top] - model["prior"][top]
        open_ = np.flatnonzero(ll_full - now > cost)   # no set can gain more than the full mixture
        k = 2
        while len(open_) and k <= n_lang:
            allow = np.zeros((len(open_), n_lang))
            np.put_along_axis(allow, order[open_, :k], 1.0, axis=1)
            pi, ll = em(open_, allow)
            better = ll - now[open_] > cost[open_]
            open_, pi = open_[better], pi[better]
            now[open_] = ll[better]
            pick[open_], value[open_], count[open_] = pi.argmax(1), pi.max(1), k
            k += 1
    best[ids], share[ids], size[ids] = pick, value, count
    return best, share, size


def with_language(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """Every row and column of ``docs`` plus a struct ``(lang, score, n_langs)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<lang: string, score: double, n_langs: int>"
    limit = max(1 << 16, SLICE // max(2, len(model["langs"]) // 4))

    @F.arrow_udf(kind)
    def predict(texts: pa.Array) -> pa.Array:
        m = shared.value
        names = np.array([*m["langs"], "und"], dtype=object)
        data, off = T.text_bytes(texts)
        out = ([], [], [])
        for i, j in T.slices(off, limit):
            got = infer(data[off[i]:off[j]], off[i:j + 1] - off[i], m)
            for o, g in zip(out, got):
                o.append(g)
        best, share, size = (np.concatenate(o) if o else np.zeros(0, int) for o in out)
        return pa.StructArray.from_arrays(
            [pa.array(names[best], pa.string()), pa.array(share, pa.float64()), pa.array(size, pa.int32())],
            names=["lang", "score", "n_langs"])

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    got = predict(F.col(text_col))
    none = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0).alias("n_langs")).cast(kind)
    tmp = fresh(docs, f"_{out_col}_raw")
    return (docs.withColumn(tmp, got)
            .withColumn(out_col, F.when(has_letter, F.col(tmp)).otherwise(none)).drop(tmp))
