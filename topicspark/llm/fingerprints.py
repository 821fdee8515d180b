"""Operator 7: document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words, weighted by their count.  For every
sample k a term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; with
``t = floor(ln(w) / r + b)`` and ``ln y = r (t - b)`` the sample is the term
that minimises ``ln c - ln y - r`` (Ioffe 2010).  Two texts agree in a sample
with a probability equal to their generalised Jaccard similarity; the minimum
itself names the (term, t) it came from.

All steps are built-in DataFrame functions.  Texts are dealt once by row key;
counting and sampling need no further shuffle, because a row's terms are
already in its partition.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as
empty; texts without words have the fingerprint of 'no term' and are alike to
each other (1) and to nothing else (0); equal texts have equal fingerprints.
Rows equal in id and text are one document; the next document is the next
different row by (id descending, row key), null ids last; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint
from topicspark.operators.ranking import with_global_index

SAMPLES = 32
BLOCK = 8                 # samples per generated row
_BITS = 25


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << _BITS) - 1)) + F.lit(0.5)) / F.lit(float(1 << _BITS))


def word_pairs(text: Column) -> Column:
    """Array of ``(w, x)``: each word and its successor (empty at the end)."""
    words = F.split(text, r"[ \t-\r]+")
    return F.arrays_zip(words.alias("w"), F.slice(words, 2, F.size(words)).alias("x"))


def signatures(rows: DataFrame, key: str, texts: list[str], meta: list[Column], samples: int = SAMPLES) -> DataFrame:
    """``(key, sig_0, sig_1, .., meta)``: the samples of each text column of
    ``rows``, which must be unique and already dealt by ``key``.  ``meta`` are
    long columns that travel along as rows of their own."""
    kind = "array<struct<w: string, x: string>>"
    zipped = [word_pairs(F.col(t)).cast(kind) for t in texts]
    extra = F.array(*[F.struct(m.cast("string").alias("w"), F.lit(None).cast("string").alias("x")) for m in meta]).cast(kind)
    n_text, n_meta = len(texts), len(meta)
    staged = rows.select(key, *[z.alias(f"_z{i}") for i, z in enumerate(zipped)], extra.alias("_zm"))
    staged = staged.select(key, *[F.size(f"_z{i}").alias(f"_s{i}") for i in range(n_text)],
                           F.posexplode(F.concat(*[F.col(f"_z{i}") for i in range(n_text)], F.col("_zm"))).alias("_p", "_e"))
    ends = [reduce(lambda a, b: a + b, [F.col(f"_s{j}") for j in range(i + 1)]) for i in range(n_text)]
    is_meta = F.col("_p") >= ends[-1]
    tag = F.when(is_meta, F.col("_p") - ends[-1] + 1).otherwise(0)
    word, after = F.col("_e.w"), F.nullif(F.col("_e.x"), F.lit(""))
    counts = []
    for i in range(n_text):
        mine = F.col("_p") < ends[i]
        if i:
            mine = mine & (F.col("_p") >= ends[i - 1])
        value = F.when(mine, F.lit(1)).otherwise(F.lit(0)).cast("long")
        counts.append(F.when(is_meta, word.cast("long")).otherwise(value) if i == 0 else value)
    terms = (staged.where(is_meta | (word != ""))
             .select(key, tag.alias("_tag"), F.when(is_meta, F.lit(0)).otherwise(F.xxhash64(word, after)).alias("_h"),
                     *[c.alias(f"_c{i}") for i, c in enumerate(counts)])
             .groupBy(key, "_tag", "_h").agg(*[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(n_text)]))
    blocks = samples // BLOCK
    wide = terms.withColumn("_b", F.explode(F.when(F.col("_tag") == 0, F.array(*[F.lit(b) for b in range(blocks)]))
                                            .otherwise(F.array(F.lit(0)))))
    drawn = {}
    for j in range(BLOCK):
        seed = F.col("_b") * BLOCK + j
        drawn[f"_x{j}"] = F.xxhash64("_h", seed)
        drawn[f"_y{j}"] = F.xxhash64(seed, "_h")
    wide = wide.withColumns(drawn)
    draws = {}
    for j in range(BLOCK):
        x, y = F.col(f"_x{j}"), F.col(f"_y{j}")
        draws[f"_r{j}"] = -F.ln(_uniform(x, 0) * _uniform(x, _BITS))
        draws[f"_q{j}"] = F.ln(-F.ln(_uniform(y, 0) * _uniform(y, _BITS)))
        draws[f"_u{j}"] = ((F.shiftrightunsigned(x, 50) * F.lit(1 << 14) + F.shiftrightunsigned(y, 50)) + F.lit(0.5)) \
            / F.lit(float(1 << 28))
    wide = wide.select(key, "_tag", "_b", *[F.col(f"_c{i}") for i in range(n_text)],
                       *[F.when((F.col("_tag") == 0) & (F.col(f"_c{i}") > 0), F.ln(F.col(f"_c{i}").cast("double"))).alias(f"_w{i}")
                         for i in range(n_text)], *[c.alias(k) for k, c in draws.items()])
    mins = []
    for i in range(n_text):
        for j in range(BLOCK):
            r, b = F.col(f"_r{j}"), F.col(f"_u{j}")
            t = F.floor(F.col(f"_w{i}") / r + b)
            mins.append(F.min(F.col(f"_q{j}") - r * (t - b) - r).alias(f"_m{i}_{j}"))
    metas = [F.max(F.when(F.col("_tag") == m + 1, F.col("_c0"))).alias(f"_meta{m}") for m in range(n_meta)]
    low = wide.groupBy(key, "_b").agg(*mins, *metas)
    part = low.select(key, "_b", *[F.col(f"_meta{m}") for m in range(n_meta)], *[
        F.array(*[F.coalesce(F.xxhash64(F.col(f"_m{i}_{j}")).bitwiseAND(F.lit(0xFFFFFFFF)) * F.col(f"_m{i}_{j}").isNotNull().cast("long"), F.lit(0))
                  for j in range(BLOCK)]).alias(f"_a{i}") for i in range(n_text)])
    joined = part.groupBy(key).agg(
        *[F.array_sort(F.collect_list(F.struct("_b", f"_a{i}"))).alias(f"_l{i}") for i in range(n_text)],
        *[F.max(f"_meta{m}").alias(f"meta_{m}") for m in range(n_meta)])
    # a row without any word has block 0 alone (from its meta rows): fill up with 'no term'
    full = [F.flatten(F.expr(f"transform(sequence(0, {blocks - 1}), b -> "
                             f"coalesce(try_element_at(transform(_l{i}, e -> e._a{i}), int(b + 1)), "
                             f"transform(sequence(1, {BLOCK}), z -> 0L)))")).alias(f"sig_{i}") for i in range(n_text)]
    return joined.select(key, *full, *[F.col(f"meta_{m}") for m in range(n_meta)])


def likeness(a: str, b: str) -> Column:
    """Share of equal samples."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> if(x = y, 1.0D, 0.0D)), 0.0D, (s, x) -> s + x)") / F.size(a)


def as_text(sig: str) -> Column:
    """Eight hexadecimal digits per sample."""
    return F.lower(F.expr(f"array_join(transform({sig}, x -> lpad(hex(x), 8, '0')), '')"))


def _as_longs(digest: Column) -> list[Column]:
    """A 64-digit hexadecimal digest as eight longs of 32 bits."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]


def _from_longs(cols: list[str]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(F.col(c)), 8, "0") for c in cols]))


def compare(docs: DataFrame, samples: int = SAMPLES, share: int = 3, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text (the last
    ``n // share`` code points replaced by the first ones of the next document).

    Returns ``(id, n_chars, edited_sha256, sig, edited_sig, next_sig)``."""
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    base = base.withColumn("_rk", F.xxhash64("_id", "_text"))
    ids = base.groupBy("_rk").agg(F.first("_id").alias("_id"), F.max(F.length("_text")).alias("n"),
                                  F.count(F.lit(1)).alias("copies"))
    ids = with_global_index(ids, [F.col("_id").desc_nulls_last(), F.col("_rk").asc()], "idx")
    total = ids.count()
    after = ids.select(F.col("idx").alias("_nidx"), F.col("_rk").alias("_next"))
    chain = checkpoint(ids.withColumn("_nidx", (F.col("idx") + 1) % F.lit(max(total, 1))).join(after, "_nidx")
                       .select("_rk", "_id", "n", "copies", "_next"))
    dealt = base.select("_rk", "_text").repartition(F.col("_rk"))
    one = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_rk").orderBy("_rk"))) \
        .where(F.col("_i") == 1).select("_rk", "_text")
    need = F.floor(F.col("n") / share).cast("int")
    heads = (one.withColumnRenamed("_rk", "_next").join(chain.select(F.col("_rk").alias("_for"), "_next", "n"), "_next")
             .select(F.col("_for"), need.alias("_need"), F.col("n").alias("_n"),
                     F.expr("left(_text, cast(floor(n / %d) as int))" % share).alias("_head")))
    both = one.join(heads, F.col("_rk") == F.col("_for")) \
        .select("_rk", "_text", F.concat(F.expr("left(_text, cast(_n - _need as int))"), F.col("_head")).alias("_edited"))
    digest = F.sha2("_edited", 256)
    sig = checkpoint(signatures(both, "_rk", ["_text", "_edited"], _as_longs(digest), samples))
    nxt = sig.select(F.col("_rk").alias("_next"), F.col("sig_0").alias("next_sig"))
    out = sig.join(chain, "_rk").join(nxt, "_next")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("_id").alias("id"), F.col("n").cast("long").alias("n_chars"),
                      _from_longs([f"meta_{m}" for m in range(8)]).alias("edited_sha256"),
                      F.col("sig_0").alias("sig"), F.col("sig_1").alias("edited_sig"), "next_sig")
