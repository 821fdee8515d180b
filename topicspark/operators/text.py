"""Text operators: tokenise, drop stop words, clean, lemmatise, count.

Tokens are kept long: ``(doc_id, pos, token)``.  Everything runs as built-in
expressions (regex, split, higher-order array functions) inside whole-stage
codegen; the only joins are against the vocabulary-sized lemma table, which
AQE broadcasts when its measured size allows and otherwise sort-merge joins
with skew splitting for hot words.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from topicspark.session import checkpoint
from topicspark.functions.constants import (
    CLEAN_RE,
    CONTRACTION_SPLITS,
    GAP_RE,
    ENGLISH_STOP_WORDS,
    NOUN_SUFFIX_RULES,
    WHITESPACE_RE,
)

LEMMAS_SENT = 500_000     # changed lemmas that are sent to every task, at most


def split_words(text: Column) -> Column:
    """lower + split on runs of Unicode whitespace, empty edge pieces dropped."""
    return F.filter(F.split(F.lower(text), WHITESPACE_RE), lambda x: x != F.lit(""))


# ---------------------------------------------------------------- T1, T2, T3

def whitespace_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Lower-case and split on whitespace; punctuation stays on the words.

    Returns ``(id_col, pos int, token)``; null text gives no rows.
    """
    return df.select(id_col, F.posexplode(split_words(F.col(text_col))).alias("pos", "token"))


def remove_stopwords(tokens: DataFrame, stopwords: Iterable[str] | None = None,
                     col: str = "token") -> DataFrame:
    """Drop exact stop-word matches.  A literal IN list becomes a hash set
    lookup (InSet) in the filter, so no join and no shuffle."""
    sw = list(ENGLISH_STOP_WORDS if stopwords is None else stopwords)
    return tokens.where(~F.col(col).isin(sw))


def word_frequencies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     stopwords: Iterable[str] | None = None) -> DataFrame:
    """T1+T2+T3: per-document word counts ``(id_col, word, cnt)``.

    Map-side partial aggregation collapses each document's tokens before the
    shuffle, so a document with many repeats ships one row per distinct word.
    """
    toks = remove_stopwords(whitespace_tokens(df, text_col, id_col), stopwords)
    return toks.groupBy(id_col, F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("cnt"))


def word_frequency_map(counts: DataFrame, id_col: str = "doc_id", word_col: str = "word",
                       count_col: str = "cnt") -> DataFrame:
    """Map view ``(id_col, word_freq map<string,bigint>)`` of a count table.

    One map per document: the group is bounded by that document's own text.
    """
    return counts.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(word_col), F.col(count_col)))).alias("word_freq"))


# ---------------------------------------------------------------- T4, T5

def strip_chars_col(text: Column) -> Column:
    """T4 as a column: each digit and each char that is neither a word char nor
    whitespace becomes one space (``_`` survives)."""
    return F.regexp_replace(text, CLEAN_RE, " ")


def strip_chars(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """T4: ``(id_col, text_col)`` with punctuation and digits replaced by spaces."""
    return df.select(id_col, strip_chars_col(F.col(text_col)).alias(text_col))


def _split_contractions(arr: Column) -> Column:
    def one(x: Column) -> Column:
        expr = None
        for word, parts in CONTRACTION_SPLITS:
            val = F.array(*[F.lit(p) for p in parts])
            expr = F.when(x == word, val) if expr is None else expr.when(x == word, val)
        return expr.otherwise(F.array(x))
    return F.flatten(F.transform(arr, one))


def _split_where_found(words: Column) -> Column:
    """Only texts that hold a contraction go through its splits.  The lambda over
    an array of one names the words, so they are made once for all uses."""
    return F.transform(F.array(words), lambda w: F.when(
        F.exists(w, lambda x: x.isin([word for word, _ in CONTRACTION_SPLITS])), _split_contractions(w)).otherwise(w))[0]


def _pieces(text: Column) -> Column:
    """The pieces of the cleaned text, empty ones included.  One regex takes what
    T4 blanks and the white space around it together, so the split is at single blanks."""
    return F.split(F.lower(F.regexp_replace(text, GAP_RE, " ")), " ")


def clean_words(text: Column) -> Column:
    """T4+T5 as a column: the word tokens of the cleaned text."""
    return _split_where_found(F.filter(_pieces(text), lambda x: x != F.lit("")))


def clean_words_without(text: Column, stopwords: list[str]) -> Column:
    """``clean_words`` less the stop words, in one filter."""
    return F.filter(_split_where_found(_pieces(text)), lambda x: ~x.isin([*stopwords, ""]))


def word_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """T5: word tokens of already cleaned text: lower, whitespace split, then the
    fixed contraction splits.  Returns ``(id_col, pos, token)``."""
    arr = _split_contractions(split_words(F.col(text_col)))
    return df.select(id_col, F.posexplode(arr).alias("pos", "token"))


def clean_word_tokens(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      stopwords: Iterable[str] | None = None) -> DataFrame:
    """T4+T5+T2: cleaned, tokenised, stop words removed; original positions kept."""
    cleaned = df.select(id_col, strip_chars_col(F.col(text_col)).alias(text_col))
    return remove_stopwords(word_tokens(cleaned, text_col, id_col), stopwords)


# ---------------------------------------------------------------- T6

def lemma_table(words: DataFrame, lexicon: DataFrame | None = None, word_col: str = "word") -> DataFrame:
    """``(word, lemma)`` for each distinct word, as a noun.

    Candidates are the word itself and every noun suffix detachment that
    applies; candidates present in ``lexicon`` survive, the shortest wins and
    ties go by rule order, the word itself last; with no survivor the lemma
    is the word.  The lexicon defaults to the vocabulary itself.
    Work is one row per distinct word (never per token).
    """
    # written once: both the candidate side and the lexicon side read it,
    # so the text behind ``words`` is tokenised a single time
    vocab = checkpoint(words.select(F.col(word_col).alias("word")).distinct())
    changed = changed_lemmas(vocab, lexicon, word_col)
    return vocab.join(changed, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def may_change(word: Column) -> Column:
    """Whether a suffix detachment applies; other words are their own lemma."""
    return reduce(lambda a, b: a | b, [word.endswith(suf) for suf, _ in NOUN_SUFFIX_RULES])


def changed_lemmas(vocab: DataFrame, lexicon: DataFrame | None = None, word_col: str = "word") -> DataFrame:
    """``(word, lemma)`` of the words of ``vocab (word)``, distinct, whose lemma
    is another word.  A detachment is never longer than the word and goes
    before it on equal length, so the word itself is no candidate here."""
    cands = []
    for i, (suf, rep) in enumerate(NOUN_SUFFIX_RULES, start=1):
        stem = F.expr(f"substring(word, 1, length(word) - {len(suf)})")
        cands.append(F.struct(F.lit(i).alias("prio"),
                              F.when(F.col("word").endswith(suf), F.concat(stem, F.lit(rep))).alias("cand")))
    exploded = vocab.where(may_change(F.col("word"))).select("word", F.inline(F.array(*cands))).where("cand is not null and cand <> ''")
    lex = (vocab if lexicon is None else lexicon.select(F.col(word_col).alias("word"))) \
        .select(F.col("word").alias("cand"))
    hits = exploded.join(lex, "cand", "left_semi")
    return hits.groupBy("word").agg(
        F.min(F.struct(F.length("cand").alias("len"), F.col("prio"), F.col("cand"))).alias("b")).select("word", F.col("b.cand").alias("lemma"))


def lemmatize(tokens: DataFrame, lemmas: DataFrame, col: str = "token") -> DataFrame:
    """Replace ``col`` by its lemma (words missing from the table stay as they are)."""
    lm = lemmas.select(F.col("word").alias("_w"), F.col("lemma").alias("_lemma"))
    return (tokens.join(lm, F.col(col) == F.col("_w"), "left")
            .withColumn(col, F.coalesce(F.col("_lemma"), F.col(col)))
            .drop("_w", "_lemma"))


def clean_token_rows(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                     stopwords: Iterable[str] | None = None, positions: bool = True) -> DataFrame:
    """T4+T5+T2 as one row per text: ``(id_col, _t array<(pos, token)>)``, or
    ``_t array<token>`` without the positions: the tokens of
    ``clean_word_tokens`` (null text: null)."""
    sw = list(ENGLISH_STOP_WORDS if stopwords is None else stopwords)
    if not positions:
        return df.select(id_col, clean_words_without(F.col(text_col), sw).alias("_t"))
    arr = clean_words(F.col(text_col))
    placed = F.transform(arr, lambda x, i: F.struct(i.alias("pos"), x.alias("token")))
    return df.select(id_col, F.filter(placed, lambda x: ~x["token"].isin(sw)).alias("_t"))


def lemma_tokens(rows: DataFrame, id_col: str = "doc_id", lexicon: DataFrame | None = None,
                 sent: int = LEMMAS_SENT) -> DataFrame:
    """T6 over written rows of ``clean_token_rows``: ``(id_col[, pos], token)``.

    The changed lemmas are written first, so their number is known: up to
    ``sent`` of them go to every task and no token is shuffled; where there
    are more, only tokens that a detachment applies to meet the table."""
    if rows.schema["_t"].dataType.elementType.simpleString() == "string":
        toks = rows.select(id_col, F.explode("_t").alias("token"))
    else:
        toks = rows.select(id_col, F.inline("_t"))
    vocab = checkpoint(toks.select(F.col("token").alias("word")).distinct())
    seen = {"n": F.count(F.lit(1))}
    changed = checkpoint(changed_lemmas(vocab, lexicon), observe=seen)
    if seen["n"] <= sent:
        return lemmatize(toks, F.broadcast(changed))
    met = lemmatize(toks.where(may_change(F.col("token"))), changed)
    return met.unionByName(toks.where(~may_change(F.col("token"))))


# ---------------------------------------------------------------- T7

def clean_and_normalize(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                        stopwords: Iterable[str] | None = None,
                        lexicon: DataFrame | None = None) -> DataFrame:
    """Cleaned text ``(id_col, text_col)``: tokens without stop words,
    lemmatised, joined by single spaces in their original order.  Documents
    with no tokens (or null text) give ''; rows that share an id stay apart.

    The text is tokenised once, into a written array per row; the vocabulary is
    read from it.  A row is joined with one map of those of its own words that
    have another lemma, bounded by its text."""
    sw = list(ENGLISH_STOP_WORDS if stopwords is None else stopwords)
    arr = clean_words(F.col(text_col))
    rows = checkpoint(df.select(F.col(id_col), F.filter(F.coalesce(arr, F.array().cast("array<string>")), lambda x: ~x.isin(sw)).alias("_t"))
                      .withColumn("_row", F.monotonically_increasing_id()))
    lemmas = lemma_table(rows.select(F.explode(F.array_distinct("_t")).alias("word")), lexicon)
    changed = lemmas.where(F.col("lemma") != F.col("word"))   # only these need the join
    pairs = rows.select("_row", F.explode(F.array_distinct("_t")).alias("word")).join(changed, "word")
    maps = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("_m"))
    done = rows.join(maps, "_row", "left")
    text = F.array_join(F.transform("_t", lambda x: F.coalesce(F.try_element_at("_m", x), x)), " ")
    return done.select(id_col, text.alias(text_col))


def clean_word_counts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      stopwords: Iterable[str] | None = None,
                      lexicon: DataFrame | None = None, sent: int = LEMMAS_SENT) -> DataFrame:
    """Counts of the cleaned text: T3 applied to the output of T4-T7.

    Same result as splitting the cleaned string again.  The words of a row are
    counted within the row and written once; the vocabulary and the lemmas come
    from these counts.  Only counts that may meet another of their document are
    shuffled: words that have another lemma or are one, and rows that share
    their id.  Lemmas that are stop words are dropped (the second T2 pass).
    Returns ``(id_col, word, cnt)``, each (document, word) once.
    """
    sw = list(ENGLISH_STOP_WORDS if stopwords is None else stopwords)
    rows = checkpoint(df.select(id_col, counted(clean_words_without(F.col(text_col), sw)).alias("_e")))
    vocab = checkpoint(rows.select(F.explode("_e.word").alias("word")).distinct())
    changed = checkpoint(changed_lemmas(vocab, lexicon), observe=(seen := {"n": F.count(F.lit(1))}))
    entries = rows.select(id_col, F.inline("_e"))
    if seen["n"] > sent:
        met = lemmatize(entries.where(may_change(F.col("word"))), changed, "word")
        return _summed(remove_stopwords(met, sw, "word").unionByName(entries.where(~may_change(F.col("word")))), id_col)
    targets = changed.select(F.col("lemma").alias("word")).distinct().join(changed.select("word"), "word", "left_anti")
    known = F.broadcast(checkpoint(changed.unionByName(targets.withColumn("lemma", F.col("word")))))
    shared = checkpoint(rows.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_id"),
                        observe=(again := {"n": F.count(F.lit(1))}))
    alone, more = entries, None
    if again["n"]:
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        alone = rows.join(shared, same, "left_anti").select(id_col, F.inline("_e"))
        more = lemmatize(rows.join(shared, same, "left_semi").select(id_col, F.inline("_e")), known, "word")
    single = alone.join(known, "word", "left_anti").select(id_col, "word", F.col("cnt").cast("long").alias("cnt"))
    met = alone.join(known, "word").select(id_col, F.col("lemma").alias("word"), "cnt")
    return single.unionByName(_summed(remove_stopwords(met if more is None else met.unionByName(more), sw, "word"), id_col))


def counted(words: Column) -> Column:
    """Array of words -> array of ``(word, cnt)``, each word once: the sorted
    array is cut where the word changes (null: null)."""
    def runs(s: Column, at: Column) -> Column:
        return F.transform(at, lambda a, j: F.struct(F.get(s, a).alias("word"), (F.coalesce(F.get(at, j + 1), F.size(s)) - a).alias("cnt")))

    def cut(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda at: runs(s, at))[0]

    # a lambda over an array of one names its value, so it is made once
    return F.transform(F.array(F.sort_array(words)), cut)[0]


def _summed(entries: DataFrame, id_col: str) -> DataFrame:
    return entries.groupBy(id_col, "word").agg(F.sum("cnt").cast("long").alias("cnt"))


# ---------------------------------------------------------------- T8, T9

def daily_word_frequencies(counts: DataFrame, date_col: str = "date", word_col: str = "word",
                           count_col: str = "cnt") -> DataFrame:
    """Sum per-document bags by date -> long ``(date, word, word_freq)``.

    Rows with a null date are dropped (as a group-by on the date does)."""
    return (counts.where(F.col(date_col).isNotNull())
            .groupBy(date_col, word_col)
            .agg(F.sum(count_col).cast("long").alias("word_freq")))


def to_long_format(df: DataFrame, date_col: str = "date", bag_col: str = "word_freq",
                   word_col: str = "word") -> DataFrame:
    """``(date, word_id, word_freq)``.  A map column is exploded (only the
    words present give rows); a long table is renamed in place."""
    if isinstance(df.schema[bag_col].dataType, MapType):
        return df.select(date_col, F.explode(bag_col).alias("word_id", "word_freq")) \
            .withColumn("word_freq", F.col("word_freq").cast("long"))
    return df.select(date_col, F.col(word_col).alias("word_id"), F.col(bag_col).cast("long").alias("word_freq"))


# ---------------------------------------------------------------- O2

def tf_idf(counts: DataFrame, id_col: str = "doc_id", word_col: str = "word",
           count_col: str = "cnt") -> DataFrame:
    """TF-IDF over a count table with one row per (document, word):
    ``tf * ln((1 + N) / (1 + df))`` with tf the raw count.  The counts are
    written once and read for the document frequencies, the corpus size and
    the result; the per-word table is vocabulary sized."""
    counts = checkpoint(counts)
    n_docs = counts.select(F.countDistinct(id_col)).scalar()  # scalar subquery
    dfreq = counts.groupBy(word_col).agg(F.count(F.lit(1)).alias("df"))
    return (counts.join(dfreq, word_col)
            .select(id_col, word_col, F.col(count_col).alias("tf"), "df",
                    (F.col(count_col) * F.log((1 + n_docs) / (1 + F.col("df")))).alias("tf_idf")))
