"""Operator 10: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train linear classifiers on
hashed word densities.  With the class prior ``pi`` and the logistic loss, the
risk is ``pi R_P+ + max(0, R_U- - pi R_P-)``; where the second term falls below
zero its gradient is turned round, so it never goes far below (Kiryo et al.
2017).  An L1 step keeps only the words that matter; as it also shrinks their
weights, the scale is fitted again under the same risk afterwards, and the bias
is set so that the share of unlabelled rows called positive is the class prior.
The value of a word is the root of its density, so that a long text with a word
once is not lost beside a short one.

The training rows are a bounded sample (``max_positive``, ``max_unlabelled``
rows, chosen by a hash of the id; both bounds are parameters).  The sample is
cut into ``members`` parts, each trains one numpy classifier in its own task,
and the model is their mean.  Scoring reads every whole text in one pass with
no shuffle.

Defined results: a null text counts as empty; an empty text gets the bias
alone; equal texts get equal scores; a null id is never learnt from; with no
positive or no unlabelled row the model is empty and every score is 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm import textio as T
from topicspark.llm.common import arrow_rows, checkpoint, unit_hash

BUCKET_BITS = 20
DENSITY = 30.0
MAX_POSITIVE = 4000
MAX_UNLABELLED = 16000
MEMBERS = 2
SLICE = 4 << 20


def features(data: np.ndarray, offsets: np.ndarray):
    """``(row, bucket, value)``: hashed words, value = root of DENSITY * count / words."""
    h, row, _, _ = T.words(data, offsets)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key, cnt = np.unique((row << BUCKET_BITS) | bucket, return_counts=True)
    r = key >> BUCKET_BITS
    total = np.bincount(row, minlength=len(offsets) - 1)
    return r, key & ((1 << BUCKET_BITS) - 1), np.sqrt(DENSITY * cnt / np.maximum(total[r], 1))


def risk_gradient(z: np.ndarray, gain_p: np.ndarray, gain_u: np.ndarray) -> np.ndarray:
    """Gradient of the non-negative risk by the rows' values ``z``.  ``gain_p``
    is a row's weight in R_P+ (and, negated, in R_P-), ``gain_u`` in R_U-."""
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss_neg = np.logaddexp(0, z)                      # loss of calling a row negative
    if float(gain_u @ loss_neg - gain_p @ loss_neg) >= 0:
        return gain_p * (s - 1) + (gain_u - gain_p) * s
    return -(gain_u - gain_p) * s                      # non-negative correction


def refit(z: np.ndarray, bias: float, gain_p: np.ndarray, gain_u: np.ndarray, steps: int = 400,
          rate: float = 0.05) -> tuple[float, float]:
    """Scale of ``z`` and bias of least risk."""
    spread = float(z.std())
    if not spread:
        return 1.0, bias
    x, at, m, v = z / spread, np.array([spread, bias]), np.zeros(2), np.zeros(2)
    for t in range(1, steps + 1):
        g = risk_gradient(at[0] * x + at[1], gain_p, gain_u)
        g = np.array([g @ x, g.sum()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        at = at - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return float(at[0] / spread), float(at[1])


def matched_bias(z: np.ndarray, prior: float, otherwise: float) -> float:
    """The bias that calls a share ``prior`` of the unlabelled values ``z``
    positive, between two values; ``otherwise`` where no value is above the rest."""
    z = np.sort(z)
    at = z[min(len(z) - 1, int((1 - prior) * len(z)))]
    above = z[np.searchsorted(z, at, "right"):]
    return -float((at + above[0]) / 2) if len(above) else otherwise


def fit_nnpu(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, positive: np.ndarray,
             prior: float, steps: int = 250, rate: float = 0.1, l1: float = 2e-4):
    """One classifier: ``(buckets, weights, bias)``.  ``positive`` marks the
    rows of P; the others are U."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return np.zeros(0, np.int64), np.zeros(0), -np.inf
    seen = np.unique(bucket[positive[row]])           # words of P only: no other word can speak for P
    at = np.searchsorted(seen, bucket)
    at[at == len(seen)] = 0
    keep = seen[at] == bucket if len(seen) else np.zeros(len(bucket), bool)
    row, col, value = row[keep], at[keep], value[keep]
    df = np.bincount(col, minlength=len(seen))
    w, b = np.zeros(len(seen)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    live = df >= 2
    n = len(positive)
    gain_p = np.where(positive, prior / n_p, 0.0)     # weight of a row in R_P+ (and, negated, R_P-)
    gain_u = np.where(positive, 0.0, 1.0 / n_u)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[col] * value, minlength=n)
        g = risk_gradient(z, gain_p, gain_u)
        gw = np.bincount(col, weights=g[row] * value, minlength=len(seen)) * live
        gb = float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        scale = rate / (np.sqrt(v / c2) + 1e-4)
        w = w - scale * (m / c1)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * l1, 0)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-4)
    kept = w != 0
    z = np.bincount(row, weights=w[col] * value, minlength=n)
    scale, b = refit(z, b, gain_p, gain_u)
    return seen[kept], w[kept] * scale, matched_bias(scale * z[~positive], prior, b)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED, members: int = MEMBERS, seed: int = 7) -> dict:
    """Fit the model.  ``allowed`` is a condition on the column ``_id``: rows
    that may be learnt from (documents and labels alike)."""
    lab = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y"))
           .where(F.col("_y").isNotNull() & F.col("_id").isNotNull() & allowed)
           .groupBy("_id").agg(F.max("_y").alias("_y")))
    n_lab, n_pos = lab.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("_y") == 1).cast("long")), F.lit(0))).first()
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")) \
        .where(F.col("_id").isNotNull() & allowed)
    n_docs = base.count()
    if not n_pos or not n_docs:
        return {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -np.inf, "prior": 0.0}
    prior = float(np.clip(n_pos / n_lab, 1e-3, 0.5))
    # both samples are bounded by a parameter, so the id list below is too
    pos = lab.where((F.col("_y") == 1) & (unit_hash(F.col("_id"), seed) < max_positive / n_pos)).select("_id")
    p_rows = base.join(F.broadcast(pos), "_id", "left_semi").withColumn("_p", F.lit(True))
    u_rows = base.where(unit_hash(F.col("_id"), seed + 1) < max_unlabelled / n_docs).withColumn("_p", F.lit(False))
    rows = p_rows.unionByName(u_rows).select(
        "_p", "_text", F.pmod(F.xxhash64("_id", F.lit(seed + 2)), F.lit(members)).cast("int").alias("_member"))

    def kernel(batch):
        data, off = T.text_bytes(batch.column("_text"))
        flag = batch.column("_p").to_numpy(zero_copy_only=False)
        member = batch.column("_member").to_numpy()
        for i, j in T.slices(off, SLICE):
            r, bucket, value = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
            cut = np.searchsorted(r, np.arange(j - i + 1))
            yield {"_member": member[i:j], "_p": flag[i:j],
                   "_b": [bucket[a:z].astype("<i4").tobytes() for a, z in zip(cut[:-1], cut[1:])],
                   "_v": [value[a:z].astype("<f4").tobytes() for a, z in zip(cut[:-1], cut[1:])]}

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        bucket = [np.frombuffer(x, "<i4") for x in part["_b"]]
        row = np.repeat(np.arange(len(part)), [len(x) for x in bucket])
        out = fit_nnpu(row, np.concatenate(bucket).astype(np.int64),
                       np.concatenate([np.frombuffer(x, "<f4") for x in part["_v"]]).astype(float),
                       part["_p"].to_numpy(bool), prior)
        return pd.DataFrame({"b": [out[0].astype("<i4").tobytes()], "w": [out[1].astype("<f8").tobytes()],
                             "bias": [out[2]]})

    sample = arrow_rows(rows, kernel, "_member int, _p boolean, _b binary, _v binary")
    fitted = sample.groupBy("_member").applyInPandas(fit, "b binary, w binary, bias double").collect()
    fitted = [r for r in fitted if np.isfinite(r["bias"])]
    if not fitted:
        return {"buckets": np.zeros(0, np.int64), "weights": np.zeros(0), "bias": -np.inf, "prior": prior}
    b = np.concatenate([np.frombuffer(r["b"], "<i4") for r in fitted]).astype(np.int64)
    w = np.concatenate([np.frombuffer(r["w"], "<f8") for r in fitted])
    uniq, inv = np.unique(b, return_inverse=True)
    return {"buckets": uniq, "weights": np.bincount(inv, weights=w, minlength=len(uniq)) / len(fitted),
            "bias": float(np.mean([r["bias"] for r in fitted])), "prior": prior}


def score_texts(col: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    data, off = T.text_bytes(col)
    out = np.zeros(len(off) - 1)
    if not np.isfinite(bias):
        return out
    for i, j in T.slices(off, SLICE):
        row, bucket, value = features(data[off[i]:off[j]], off[i:j + 1] - off[i])
        # sums in bucket order of the row alone, so equal texts score alike
        z = bias + np.bincount(row, weights=table[bucket] * value, minlength=j - i)
        out[i:j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def with_score(docs: DataFrame, model: dict, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Every row and column of ``docs`` plus the score of its text.  The model
    holds at most 2^20 weights, whatever the corpus."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model["buckets"], model["weights"], model["bias"]))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        buckets, weights, bias = shared.value
        table = np.zeros(1 << BUCKET_BITS)
        table[buckets] = weights
        return pa.array(score_texts(texts, table, bias))

    return docs.withColumn(out_col, score(F.col(text_col)))
