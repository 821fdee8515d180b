"""Registered queries over the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators import text as T
from topicspark.plans.registry import register
from topicspark.session import checkpoint
from topicspark.sources import bindings, tables


@register("tok_whitespace")
def tok_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace tokens of every document."""
    return T.whitespace_tokens(tables.documents(spark, sf_dir))


@register("tok_nostop")
def tok_nostop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1+T2: whitespace tokens without stop words."""
    return T.remove_stopwords(T.whitespace_tokens(tables.documents(spark, sf_dir)))


@register("word_freq_doc")
def word_freq_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-document word counts."""
    return T.word_frequencies(tables.documents(spark, sf_dir))


@register("strip_chars")
def strip_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: digits and non-word, non-space characters become spaces."""
    return T.strip_chars(tables.documents(spark, sf_dir))


@register("tok_clean")
def tok_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4+T5: word tokens of the cleaned text, contractions split."""
    docs = T.strip_chars(tables.documents(spark, sf_dir))
    return T.word_tokens(docs)


@register("lemma_map")
def lemma_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemma of every distinct cleaned non-stop word (lexicon = that vocabulary)."""
    toks = T.clean_word_tokens(tables.documents(spark, sf_dir))
    return T.lemma_table(toks.select(F.col("token").alias("word")))


@register("lemma_tokens")
def lemma_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned non-stop tokens replaced by their lemma, positions kept."""
    rows = checkpoint(T.clean_token_rows(tables.documents(spark, sf_dir)))
    return T.lemma_tokens(rows)


@register("clean_text")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, normalised text of every document."""
    return T.clean_and_normalize(tables.documents(spark, sf_dir))


@register("daily_word_freq")
def daily_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3 then T8: whitespace word counts summed per document date."""
    counts = T.word_frequencies(tables.documents(spark, sf_dir))
    return T.daily_word_frequencies(bindings.with_document_date(counts))


@register("daily_word_long")
def daily_word_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the cleaned text per date, long format."""
    counts = T.clean_word_counts(tables.documents(spark, sf_dir))
    daily = T.daily_word_frequencies(bindings.with_document_date(counts))
    return T.to_long_format(daily)


@register("daily_bag_long")
def daily_bag_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T9, T8 on bags: a map of counts per document, exploded and summed per date."""
    bags = T.word_frequency_map(T.word_frequencies(tables.documents(spark, sf_dir)))
    long = T.to_long_format(bindings.with_document_date(bags))
    return T.daily_word_frequencies(long, word_col="word_id", count_col="word_freq")


@register("tf_idf")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: TF-IDF over the cleaned per-document counts."""
    counts = T.clean_word_counts(tables.documents(spark, sf_dir))
    out = T.tf_idf(counts)
    return out.withColumn("tf_idf", F.round("tf_idf", 6))


@register("stream_daily_word_freq")
def stream_daily_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: T1-T3 + T8 as a stream over the documents: partial counts per
    micro-batch, summed on read; all days."""
    from topicspark.streaming.daily import run_available_now
    # a pattern: the table may be one file or a folder of part files
    return run_available_now(spark, f"{sf_dir}/documents.parque[t]",
                             "doc_id long, text string, lang string, source string, n_chars long",
                             bindings.with_document_date, "daily_word_freq")
