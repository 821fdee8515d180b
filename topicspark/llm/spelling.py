"""Operator 11: spelling variants by neighbourhoods over a reduced alphabet.

1. Words are counted per text first (a text is read in stretches), then per
   task, then by Spark, so a frequent word is one row per task.
2. Every letter is hashed to one of a few symbols.  Words that differ by one
   inserted, deleted or replaced letter have reduced words that are equal or
   differ by one such edit.
3. Of every reduced word the full one-edit neighbourhood is made, as 64-bit
   codes: the code is a polynomial, so an edit changes it by a term and a shift
   of the rest.  Of two neighbours the one with the larger code finds the
   other, so half of the codes are kept.
4. Codes that belong to no word are left out early by a bit table of 64 bits a
   word, at most ``filter_bits``; where it fills up it lets more through, and
   the join decides.  The rest is joined with the codes of the vocabulary.
5. The pairs are verified on the original words.

Defined results: null texts hold no words; a null id counts as an empty one in
the choice of deleted letters; rows repeated with one id count each; equal
codes of different reduced words only add pairs that the verification drops;
texts and words of any length are worked whole; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import checkpoint

LETTERS = "A-Za-zÀ-ÿ"      # fixed by the contract
SHORTEST, TWICE, CUT, RATIO = 7, 2, 31, 10
SYMBOLS = 8
FILTER_BITS = 1 << 27                # bits of the table at most; 64 a word below that
SEGMENT = 1 << 16
STRETCH = 1 << 20                    # characters of a text taken at a time
FLUSH = 1 << 17                      # different words a task holds before it passes them on
CHUNK = 1 << 19                      # codes made at a time
LONG = 512                           # letters up to which Spark's own distance verifies a pair
_UPPER = {c: c + 32 for c in range(65, 91)}
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in pieces that cut no run of letters."""
    if len(text) <= size:
        yield text
        return
    gap, a = re.compile(f"[^{LETTERS}]"), 0
    while a < len(text):
        end = gap.search(text, min(len(text), a + size))
        b = end.start() if end else len(text)
        yield text[a:b]
        a = b


def variant(word: str, head: int, cut: int = CUT) -> str:
    """The word, less one letter where ``cut`` divides the checksum that began with ``head``."""
    h = zlib.crc32(word.encode(), head)
    if h % cut:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
               least: int = TWICE, cut: int = CUT) -> DataFrame:
    """``(word, n)``: words of ``shortest`` letters and ``least`` occurrences or more."""
    find = re.compile(f"[{LETTERS}]{{{shortest},}}")        # shorter runs give no word: a run only loses letters

    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                head = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for part in stretches(text.as_py()):
                    for word, n in Counter(find.findall(part)).items():
                        word = variant(word.lower() if word.isascii() else word.translate(_UPPER), head, cut)
                        if len(word) >= shortest:
                            found[word] += n
                    if len(found) > FLUSH:
                        yield rows(found)
                        found = Counter()
        yield rows(found)

    counts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def reduced(words: list[str], length: int, symbols: int) -> np.ndarray:
    """The symbols (1..``symbols``) of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)
    return ((points * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(symbols)) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))


def codes(s: np.ndarray) -> np.ndarray:
    return (s * _powers(s.shape[1])[:-1]).sum(1, dtype=np.uint64)


def neighbourhood(s: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, code)`` of all words one edit away from the rows of ``s``, a slice of places at a time."""
    m, length = s.shape
    power = _powers(length + 1)
    upto = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(s * power[:length], 1, dtype=np.uint64)], 1)
    whole = upto[:, -1:]
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    step = max(1, CHUNK // max(1, m * symbols))
    for a in range(0, length + 1, step):
        b = min(length + 1, a + step)
        e = min(length, b)
        if e > a:
            at, here = s[:, a:e], power[a:e]
            shorter = upto[:, a:e] + (whole - upto[:, a + 1:e + 1]) * _BACK
            new = np.ones(at.shape, bool)                                   # of a run of one symbol, the first goes
            new[:, 1:] = at[:, 1:] != at[:, :-1]
            if a:
                new[:, 0] = s[:, a] != s[:, a - 1]
            row, col = np.nonzero(new)
            yield row, shorter[row, col]
            other = letters[None, None, :] != at[:, :, None]
            changed = whole[:, :, None] + (letters[None, None, :] - at[:, :, None]) * here[None, :, None]
            row, col, c = np.nonzero(other)
            yield row, changed[row, col, c]
        behind = np.zeros((m, b - a), np.uint64)                            # symbol behind the gap, 0 at the end
        behind[:, :e - a] = s[:, a:e]
        longer = (upto[:, a:b] + (whole - upto[:, a:b]) * _BASE)[:, :, None] + letters[None, None, :] * power[a:b][None, :, None]
        row, col, c = np.nonzero(letters[None, None, :] != behind[:, :, None])
        yield row, longer[row, col, c]


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, list[str], int]]:
    """Positions and words of one length, some at a time."""
    every = words.to_pylist()
    size = np.array([len(w) for w in every], np.int64)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        step = max(1, CHUNK // int(length * (SYMBOLS + 1)))
        for i in range(0, len(at), step):
            yield at[i:i + step], [every[j] for j in at[i:i + step]], int(length)


def with_code(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(word, n, code)``: the code of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.zeros(batch.num_rows, np.uint64)
            for at, some, length in by_length(batch.column(0)):
                got[at] = codes(reduced(some, length, symbols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got.view(np.int64))], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n bigint, code bigint")


def bit_table(words: DataFrame, bits: int) -> np.ndarray:
    """One bit per code, in segments; at most ``bits / 8`` bytes reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(20)
            at %= np.uint64(bits)
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = held.reshape(-1, min(SEGMENT, bits) // 8)
        used = np.flatnonzero(rows.any(1))
        for i in range(0, len(used), 256):
            yield pa.RecordBatch.from_arrays([pa.array(used[i:i + 256]), pa.array([rows[j].tobytes() for j in used[i:i + 256]], pa.binary())],
                                             names=["seg", "bits"])

    def unite(part):
        import pandas as pd
        return pd.DataFrame({"seg": part["seg"][:1], "bits": [np.bitwise_or.reduce(
            np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), -1)).tobytes()]})

    table = np.zeros(bits // 8, np.uint8).reshape(-1, min(SEGMENT, bits) // 8)
    for r in words.select("code").mapInArrow(run, "seg bigint, bits binary").groupBy("seg") \
            .applyInPandas(unite, "seg bigint, bits binary").toLocalIterator():
        table[r.seg] = np.frombuffer(bytes(r.bits), np.uint8)
    return table.ravel()


def near_codes(words: DataFrame, symbols: int, bits: int, shared) -> DataFrame:
    """``(near, word, n)``: the own code, and those of the neighbourhood that
    are smaller and may belong to a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            word, n, own = batch.column(0), batch.column(1), batch.column(2).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(2), word, n], names=["near", "word", "n"])
            for at, some, length in by_length(word):
                for row, code in neighbourhood(reduced(some, length, symbols), symbols):
                    bit = code >> np.uint64(20)
                    bit %= np.uint64(bits)
                    maybe = (table[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    maybe &= code <= own[at[row]]
                    row, code = row[maybe], code[maybe]
                    if len(row):
                        pos = pa.array(at[row])
                        yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), word.take(pos), n.take(pos)],
                                                         names=["near", "word", "n"])

    return words.select("word", "n", "code").mapInArrow(run, "near bigint, word string, n bigint")


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by one inserted, deleted or replaced letter (time linear in their length)."""
    if len(a) > len(b):
        a, b = b, a
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a != b and (a[lo:] == b[lo + 1:] or (len(a) == len(b) and a[lo + 1:] == b[lo + 1:]))


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [one_edit(a.as_py(), b.as_py()) for a, b in zip(batch.column(0), batch.column(2))]
            yield batch.filter(pa.array(hit, pa.bool_()))

    return pairs.select("word", "n", "other", "other_n").mapInArrow(run, "word string, n bigint, other string, other_n bigint")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, bits: int = FILTER_BITS) -> DataFrame:
    """``(a, b, an, bn)``: the pairs ``a < b`` of ``words (word, n, code)`` one
    edit apart, with their counts."""
    bits = min(bits, 1 << max(10, (64 * words.count() - 1).bit_length()))
    shared = words.sparkSession.sparkContext.broadcast(bit_table(words, bits))

    def joined(some: DataFrame) -> DataFrame:
        right = some.select(F.col("code").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        return near_codes(some, symbols, bits, shared).join(right, "near").where(
            (F.col("word") != F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1))

    # Spark's bounded distance still walks a word once per letter; long words are compared by halving
    short = joined(words.where(F.length("word") <= LONG)).where(F.levenshtein("word", "other", 1) == 1)
    long = _verified(joined(words.where(F.length("word") >= LONG)).where(F.greatest(F.length("word"), F.length("other")) > LONG))
    found = short.select("word", "n", "other", "other_n").unionByName(long)
    ahead = F.col("word") < F.col("other")
    return found.select(F.least("word", "other").alias("a"), F.greatest("word", "other").alias("b"),
                        F.when(ahead, F.col("n")).otherwise(F.col("other_n")).alias("an"),
                        F.when(ahead, F.col("other_n")).otherwise(F.col("n")).alias("bn")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``forms (word, form)`` -> ``(word, root)`` by doubling the steps until none moves."""
    cur = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        seen = {"moved": F.count("_next")}
        cur = checkpoint(cur.join(ahead, "root", "left"), observe=seen)
        cur = cur.select("word", F.coalesce("_next", "root").alias("root"))
        if not seen["moved"]:
            return cur


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS,
             filter_bits: int = FILTER_BITS, ratio: int = RATIO, shortest: int = SHORTEST, least: int = TWICE,
             cut: int = CUT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per word."""
    words = checkpoint(with_code(vocabulary(docs, id_col, text_col, shortest, least, cut), symbols))
    pairs = checkpoint(near_pairs(words, symbols, filter_bits))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("least"), "other")).alias("_best"))
    enough = -F.col("_best.least") >= ratio * F.col("n")
    placed = checkpoint(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(enough, F.col("_best.other")).alias("form"), F.when(enough, -F.col("_best.least")).alias("form_n")))
    ends = roots(placed.where(F.col("form").isNotNull()))
    return placed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
