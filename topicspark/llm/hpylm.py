"""Operator 2: language-model scores of a hierarchical Pitman-Yor model.

The model.  Every word that occurs as a context has a restaurant over the
words that follow it; all of them share one parent, the unigram restaurant,
whose base is uniform over the known words and one unknown.  Customers of a
dish sit at tables; every table of a context restaurant is a customer of the
parent.  Seating is sampled by Gibbs sweeps (each dish's customers are seated
anew given the other tables of the restaurant), and the predictive
probabilities are averaged over the kept sweeps:

    p(w | u) = (c_uw - d t_uw + (theta + d T_u) p(w)) / (theta + c_u)

The job.  Texts are dealt by row key over groups of bounded bytes.  A group
reduces its tokens to distinct (context, word) pairs with training counts and
sends them, packed, to the buckets of their contexts, so nothing travels per
token.  Contexts with more than ``1 / HOT`` of all tokens are spread over
several buckets by the following word; their part restaurants are added up
when read.  A bucket seats its restaurants and answers every group with
``c - d t`` per pair and the tables per context; the tables per word go on to
the word's bucket, which seats the unigram restaurant and answers with the
parent's numbers.  Each group then scores its texts.

While a context restaurant is seated, the parent's probability of a word is
its share of the training tokens if that is above ``1 / KNOWN`` (a list of at
most ``KNOWN`` words) and the mean of the others otherwise.  Dishes beyond 64
customers are seated in blocks of a sixteenth of those present.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, plus
one end per text; null texts count as empty (one token, the end); rows with a
null id are scored and never learnt from; rows equal in id and text are scored
alike and each count in training; with no training row every token has the
uniform probability 1; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm import textio as T
from topicspark.llm.common import arrow_rows, checkpoint, release

GROUP = 12_000_000        # bytes of text per group
BUCKET = 8_000_000        # bytes of corpus per bucket of contexts
KNOWN = 100_000
HOT = 1000
SALT = 16
DISCOUNT, STRENGTH = (0.75, 0.8), (1.0, 1.0)     # context restaurants, unigram restaurant
BURN, KEEP = 2, 3
SLICE = 4 << 20
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(token, row)``: word hashes of the texts, each followed by its end."""
    data, off = T.text_bytes(texts)
    out_t, out_r = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in T.slices(off, SLICE):
        h, row, _, _ = T.words(data[off[i]:off[j]], off[i:j + 1] - off[i])
        n = j - i
        count = np.bincount(row, minlength=n)
        tok = np.empty(len(h) + n, np.uint64)
        tok[np.arange(len(h)) + row] = h
        tok[np.cumsum(count + 1) - 1] = END
        out_t.append(tok)
        out_r.append(i + np.repeat(np.arange(n), count + 1))
    return np.concatenate(out_t), np.concatenate(out_r)


def _bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    return ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _home(u: np.ndarray, w: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a (context, word) pair."""
    spread = np.isin(u, hot) | (u == BEGIN)
    salt = (T.mix64(w) % np.uint64(SALT)).astype(np.int64)
    return (_bucket(u, buckets) + np.where(spread, salt, 0)) % buckets


def _pack_contexts(ctx: np.ndarray, words: np.ndarray) -> bytes:
    """Contexts as steps through the words of the same bucket, which most of
    them are; the others (spread contexts, the begin) are written out."""
    at = np.searchsorted(words, ctx)
    at[at == len(words)] = 0
    own = words[at] == ctx if len(words) else np.zeros(len(ctx), bool)
    step = np.zeros(len(ctx), "<i4")
    step[own] = np.diff(at[own], prepend=0)
    return step.tobytes() + (~own).astype("u1").tobytes() + ctx[~own].astype("<u8").tobytes()


def _unpack_contexts(raw: bytes, words: np.ndarray, n: int) -> np.ndarray:
    step, away = np.frombuffer(raw[:4 * n], "<i4"), np.frombuffer(raw[4 * n:5 * n], "u1").astype(bool)
    out = np.empty(n, np.uint64)
    out[~away] = words[np.cumsum(step[~away])]
    out[away] = np.frombuffer(raw[5 * n:], "<u8")
    return out


class Pairs:
    """The distinct pairs and words of a group, in an order that depends on
    the group's set of texts alone."""

    def __init__(self, tok: np.ndarray, row: np.ndarray, hot: np.ndarray, buckets: int):
        self.words, at = np.unique(tok, return_inverse=True)
        first = np.append(True, row[1:] != row[:-1])[:len(row)]
        n = len(self.words)
        ctx = np.empty(len(tok), np.int64)
        ctx[1:] = at[:-1]
        ctx[first] = n
        key, self.of_token = np.unique(ctx * (n + 1) + at, return_inverse=True)
        self.u_at, self.w_at = key // (n + 1), key % (n + 1)
        self.token_word, self.token_ctx = at, ctx
        names = np.append(self.words, BEGIN)
        self.u, self.w = names[self.u_at], self.words[self.w_at]
        self.home = _home(self.u, self.w, hot, buckets)
        self.order = np.lexsort((self.w, self.u, self.home))      # how the pairs are sent
        self.cut = np.searchsorted(self.home[self.order], np.arange(buckets + 1))
        self.word_cut = np.searchsorted(_bucket(self.words, buckets), np.arange(buckets + 1))


def word_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, words, counts)``: training tokens per word, packed per bucket."""
    def kernel(batch):
        texts, train = batch.column("_text"), batch.column("_train").to_numpy(zero_copy_only=False)
        texts = texts.filter(pa.array(train))
        _, off = T.text_bytes(texts)
        for i, j in T.slices(off, 2 * SLICE):
            tok, _ = tokens(texts.slice(i, j - i))
            w, c = np.unique(tok, return_counts=True)
            cut = np.searchsorted(_bucket(w, buckets), np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            yield {"bucket": used, "words": [w[cut[b]:cut[b + 1]].tobytes() for b in used],
                   "counts": [c[cut[b]:cut[b + 1]].astype("<i8").tobytes() for b in used]}

    def add(key, part: pd.DataFrame) -> pd.DataFrame:
        w = np.concatenate([np.frombuffer(x, "<u8") for x in part["words"]])
        c = np.concatenate([np.frombuffer(x, "<i8") for x in part["counts"]])
        u, inv = np.unique(w, return_inverse=True)
        c = np.bincount(inv, weights=c).astype(np.int64)
        return pd.DataFrame({"bucket": [int(key[0])], "words": [u.astype("<u8").tobytes()],
                             "counts": [c.astype("<i8").tobytes()], "n": [int(c.sum())], "v": [len(u)]})

    sent = arrow_rows(docs.select("_text", "_train"), kernel, "bucket int, words binary, counts binary")
    return sent.groupBy("bucket").applyInPandas(
        add, "bucket int, words binary, counts binary, n bigint, v bigint")


def seat(count: np.ndarray, open_: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers sit down one by one: the next of
    n customers at t tables opens one with probability
    ``open / (open + n - discount * t)``."""
    order = np.argsort(-count, kind="stable")
    c, a = count[order], open_[order]
    t = np.ones(len(c))
    n, top = 1, int(c[0]) if len(c) else 0
    while n < top:
        live = int(np.searchsorted(-c, -n, "left"))          # dishes with more than n customers
        p = a[:live] / (a[:live] + n - discount * t[:live])
        if n < 64:
            t[:live] += rng.random(live) < p
            n += 1
        else:
            step = n // 16
            more = np.minimum(step, c[:live] - n)
            t[:live] += rng.binomial(more, np.clip(p, 0, 1))
            n += step
    out = np.empty(len(c))
    out[order] = t
    return out


def sweep(count: np.ndarray, house: np.ndarray, houses: int, prob: np.ndarray, scale: np.ndarray,
          discount: float, strength: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Gibbs sweeps over restaurants: mean tables per dish and per restaurant."""
    t = np.ones(len(count))
    sum_t, sum_house = np.zeros(len(count)), np.zeros(houses)
    some = np.flatnonzero(count > 1)
    for k in range(BURN + KEEP):
        total = np.bincount(house, weights=t, minlength=houses) * scale
        rest = np.maximum(total[house[some]] - t[some], 0)
        t[some] = seat(count[some], (strength + discount * rest) * prob[some], discount, rng)
        if k >= BURN:
            sum_t += t
            sum_house += np.bincount(house, weights=t, minlength=houses)
    return sum_t / KEEP, sum_house / KEEP


def score(docs: DataFrame, train: Column, group: int = GROUP, bucket: int = BUCKET, seed: int = 5,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, n_known, train_tokens, base_score, score)`` per row;
    ``train`` is a condition on the column ``_id``."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumns({"_rk": F.xxhash64("_id", "_text"), "_train": F.coalesce(train, F.lit(False))})
    size = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets, groups = max(1, -(-size // bucket)), max(1, -(-size // group))
    vocab = checkpoint(word_counts(base, buckets))
    n_train, n_words = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()

    def frequent(batch):
        for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist()):
            w, c = np.frombuffer(w, "<u8"), np.frombuffer(c, "<i8")
            at = np.flatnonzero(c * KNOWN > n_train)
            yield {"w": w[at].view(np.int64), "c": c[at]}
    # at most KNOWN words have a share above 1 / KNOWN
    known = arrow_rows(vocab.select("words", "counts"), frequent, "w bigint, c bigint").toPandas().sort_values("w")
    known_w = known["w"].to_numpy().view(np.uint64)
    known_c = known["c"].to_numpy()
    by = np.argsort(known_w)
    known_w, known_c = known_w[by], known_c[by]
    hot = known_w[known_c * HOT > n_train]
    tail = max(n_train - int(known_c.sum()), 1) / max(n_train, 1) / max(n_words - len(known_w), 1)
    n_docs = base.where("_train").count()
    shared = docs.sparkSession.sparkContext.broadcast((known_w, known_c, hot))
    dealt = base.withColumn("grp", F.pmod(F.xxhash64("_rk", F.lit(seed)), F.lit(groups)).cast("int"))

    def ask(key, part: pd.DataFrame) -> pd.DataFrame:
        tok, row = tokens(pa.array(part["_text"], pa.large_string()))
        pairs = Pairs(tok, row, shared.value[2], buckets)
        learn = part["_train"].to_numpy(bool)[row]
        count = np.bincount(pairs.of_token, weights=learn, minlength=len(pairs.u)).astype(np.int64)[pairs.order]
        u, w = pairs.u[pairs.order], pairs.w[pairs.order]
        rows = []
        for b in range(buckets):
            a, z = pairs.cut[b], pairs.cut[b + 1]
            s, e = pairs.word_cut[b], pairs.word_cut[b + 1]
            if z > a or e > s:
                new = np.flatnonzero(np.append(True, u[a + 1:z] != u[a:z - 1])) if z > a else np.zeros(0, np.int64)
                high, low = (w[a:z] >> np.uint64(32)).astype("<u4"), (w[a:z] >> np.uint64(16)).astype("<u2")
                rows.append((b, int(key[0]), pairs.words[s:e].astype("<u8").tobytes(),
                             _pack_contexts(u[a:z][new], pairs.words[s:e]),
                             np.diff(np.append(new, z - a)).astype("<i4").tobytes(), high.tobytes() + low.tobytes(),
                             count[a:z].astype("<i4").tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "grp", "words", "ctx", "len", "next", "cnt"])

    asked = dealt.select("grp", "_text", "_train").groupBy("grp").applyInPandas(
        ask, "bucket int, grp int, words binary, ctx binary, len binary, next binary, cnt binary")

    def answer(key, part: pd.DataFrame) -> pd.DataFrame:
        """Seat the restaurants of a bucket.  Kind 0 answers a group, kind 1
        holds tables per word for that word's bucket."""
        part = part.sort_values("grp", kind="stable")
        known_w, known_c, _ = shared.value
        ctx = [_unpack_contexts(x, np.frombuffer(w, "<u8"), len(k) // 4)
               for x, w, k in zip(part["ctx"], part["words"], part["len"])]
        n_of = [np.frombuffer(x, "<i4") for x in part["len"]]
        cnt = [np.frombuffer(x, "<i4") for x in part["cnt"]]
        w = np.concatenate([(np.frombuffer(x[:4 * len(c)], "<u4").astype(np.uint64) << np.uint64(32))
                            | (np.frombuffer(x[4 * len(c):], "<u2").astype(np.uint64) << np.uint64(16))
                            for x, c in zip(part["next"], cnt)])
        u = np.concatenate([np.repeat(x, k) for x, k in zip(ctx, n_of)])
        pair, inv = np.unique(T.mix64(u * np.uint64(0xD6E8FEB86659FD93) + w), return_inverse=True)
        c = np.bincount(inv, weights=np.concatenate(cnt), minlength=len(pair)).astype(np.int64)
        some = np.zeros(len(pair), np.int64)
        some[inv] = np.arange(len(inv))
        house_u, house = np.unique(u[some], return_inverse=True)
        word = w[some]
        dish = np.flatnonzero(c)
        at = np.searchsorted(known_w >> np.uint64(16), word[dish] >> np.uint64(16))
        at[at == len(known_w)] = 0
        hit = ((known_w[at] ^ word[dish]) >> np.uint64(16)) == 0 if len(known_w) else np.zeros(len(dish), bool)
        prob = np.where(hit, known_c[at] / max(n_train, 1), tail) if len(known_w) else np.full(len(dish), tail)
        here = np.bincount(house[dish], weights=c[dish], minlength=len(house_u))
        at = np.searchsorted(known_w, house_u)
        at[at == len(known_w)] = 0
        whole = np.where(known_w[at] == house_u, known_c[at], here) if len(known_w) else here
        whole = np.where(house_u == BEGIN, n_docs, whole)
        scale = np.maximum(whole, here) / np.maximum(here, 1)     # a spread context holds a part of its dishes here
        rng = np.random.default_rng([seed, int(key[0])])
        t, tables = sweep(c[dish], house[dish], len(house_u), prob, scale, DISCOUNT[0], STRENGTH[0], rng)
        rest = np.zeros(len(pair))
        rest[dish] = c[dish] - DISCOUNT[0] * t
        rows, a, s = [], 0, 0
        for g, words, x, k in zip(part["grp"], part["words"], ctx, n_of):
            z = a + int(k.sum())
            rows.append((0, int(key[0]), int(g), words, rest[inv[a:z]].astype("<f4").tobytes(),
                         tables[np.searchsorted(house_u, x)].astype("<f4").tobytes(), 0.0))
            a = z
        names, of = np.unique(word[dish], return_inverse=True)
        total = np.bincount(of, weights=t)
        cut = np.searchsorted(_bucket(names, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            x = names[cut[b]:cut[b + 1]]
            rows.append((1, int(b), -1, x.astype("<u8").tobytes(), total[cut[b]:cut[b + 1]].astype("<f4").tobytes(),
                         b"", float(total[cut[b]:cut[b + 1]].sum())))
        return pd.DataFrame(rows, columns=["kind", "bucket", "grp", "words", "x", "y", "total"])

    shape = "kind int, bucket int, grp int, words binary, x binary, y binary, total double"
    told = checkpoint(asked.groupBy("bucket").applyInPandas(answer, shape))
    release(docs)
    customers = told.where("kind = 1").agg(F.coalesce(F.sum("total"), F.lit(0.0))).first()[0]
    floor = 1.0 / (n_words + 1)

    def parent(key, part: pd.DataFrame) -> pd.DataFrame:
        """Seat the unigram restaurant's dishes of a bucket and answer every
        group: customers less discount per word, and training counts."""
        voc = part[part["kind"] == 2]
        words = np.frombuffer(voc["words"].iloc[0], "<u8") if len(voc) else np.zeros(0, np.uint64)
        count = np.frombuffer(voc["x"].iloc[0], "<i8") if len(voc) else np.zeros(0, np.int64)
        here = np.zeros(len(words))
        for x, k in zip(part.loc[part["kind"] == 1, "words"], part.loc[part["kind"] == 1, "x"]):
            at = np.searchsorted(words >> np.uint64(16), np.frombuffer(x, "<u8") >> np.uint64(16))
            np.add.at(here, at, np.frombuffer(k, "<f4").astype(float))
        guests = np.maximum(np.rint(here), 1).astype(np.int64)
        rng = np.random.default_rng([seed + 1, int(key[0])])
        scale = np.array([n_words / max(len(words), 1)])
        t, tables = sweep(guests, np.zeros(len(words), np.int64), 1, np.full(len(words), floor), scale,
                          DISCOUNT[1], STRENGTH[1], rng)
        rest = np.maximum(here - DISCOUNT[1] * t, 0)
        rows = [(-1, b"", b"", float(tables[0]))]
        for g, x in zip(part.loc[part["kind"] == 0, "grp"], part.loc[part["kind"] == 0, "words"]):
            x = np.frombuffer(x, "<u8")
            at = np.searchsorted(words, x)
            at[at == len(words)] = 0
            hit = words[at] == x if len(words) else np.zeros(len(x), bool)
            num = np.where(hit, rest[at], 0.0) if len(words) else np.zeros(len(x))
            cnt = np.where(hit, count[at], 0) if len(words) else np.zeros(len(x))
            rows.append((int(g), num.astype("<f8").tobytes(), cnt.astype("<i8").tobytes(), 0.0))
        out = pd.DataFrame(rows, columns=["grp", "num", "cnt", "tables"])
        out["bucket"] = int(key[0])
        return out

    lists = told.select("kind", "bucket", "grp", "words", F.when(F.col("kind") == 1, F.col("x")).alias("x"))
    lists = lists.unionByName(vocab.select(F.lit(2).alias("kind"), "bucket", F.lit(-1).alias("grp"), "words",
                                           F.col("counts").alias("x")))
    up = checkpoint(lists.groupBy("bucket").applyInPandas(
        parent, "grp int, num binary, cnt binary, tables double, bucket int"))
    release(docs)
    tables_1 = up.agg(F.coalesce(F.sum("tables"), F.lit(0.0))).first()[0]

    def rate(key, part: pd.DataFrame) -> pd.DataFrame:
        text = part[part["kind"] == 3]
        if not len(text):
            return pd.DataFrame({k: [] for k in ("_rk", "n_tokens", "n_known", "base_score", "score")}) \
                .astype({"_rk": "int64", "n_tokens": "int64", "n_known": "int64"})
        tok, row = tokens(pa.array(text["_text"], pa.large_string()))
        pairs = Pairs(tok, row, shared.value[2], buckets)
        n = len(pairs.words)
        num, cnt = np.zeros(n + 1), np.zeros(n + 1)
        rest, tables = np.zeros(len(pairs.u)), np.zeros(n + 1)
        for r in part[part["kind"] == 1].itertuples():
            s, e = pairs.word_cut[r.bucket], pairs.word_cut[r.bucket + 1]
            num[s:e], cnt[s:e] = np.frombuffer(r.x, "<f8"), np.frombuffer(r.y, "<i8")
        for r in part[part["kind"] == 0].itertuples():
            a, z = pairs.cut[r.bucket], pairs.cut[r.bucket + 1]
            if z > a:
                at = pairs.order[a:z]
                rest[at] = np.frombuffer(r.x, "<f4")
                ctx = pairs.u_at[at]
                new = np.append(True, ctx[1:] != ctx[:-1])
                tables[ctx[new]] += np.frombuffer(r.y, "<f4")
        cnt[n] = n_docs
        p_1 = (num[:n] + (STRENGTH[1] + DISCOUNT[1] * tables_1) * floor) / (STRENGTH[1] + customers)
        back = (STRENGTH[0] + DISCOUNT[0] * tables) / (STRENGTH[0] + cnt)
        back = np.where(cnt > 0, back, 1.0)
        p = rest / (STRENGTH[0] + cnt[pairs.u_at]) + back[pairs.u_at] * p_1[pairs.w_at]
        plain = np.log10((cnt[:n] + 1) / (n_train + n_words + 1))
        rows = len(text)
        return pd.DataFrame({
            "_rk": text["_rk"].to_numpy(), "n_tokens": np.bincount(row, minlength=rows),
            "n_known": np.bincount(row, weights=cnt[pairs.token_word] > 0, minlength=rows).astype(np.int64),
            "base_score": np.bincount(row, weights=plain[pairs.token_word], minlength=rows),
            "score": np.bincount(row, weights=np.log10(p)[pairs.of_token], minlength=rows)})

    def column(df: DataFrame, kind: int, **cols: str) -> DataFrame:
        return df.select("grp", F.lit(kind).alias("kind"), *[
            (F.col(cols[c]) if c in cols else F.lit(None)).cast(t).alias(c)
            for c, t in (("bucket", "int"), ("x", "binary"), ("y", "binary"), ("_rk", "bigint"), ("_text", "string"))])

    every = (column(told.where("kind = 0"), 0, bucket="bucket", x="x", y="y")
             .unionByName(column(up.where("grp >= 0"), 1, bucket="bucket", x="num", y="cnt"))
             .unionByName(column(dealt, 3, _rk="_rk", _text="_text")))
    every = every.withColumn("_rk", F.coalesce("_rk", F.lit(0))).withColumn("bucket", F.coalesce("bucket", F.lit(0)))
    rated = every.groupBy("grp").applyInPandas(
        rate, "_rk bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    rated = checkpoint(rated).groupBy("_rk").agg(*[F.max(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return (base.select("_id", "_rk", "_train").join(rated, "_rk")
            .select(F.col("_id").alias("id"), F.col("_train").alias("trained"), "n_tokens", "n_known",
                    F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score"))
