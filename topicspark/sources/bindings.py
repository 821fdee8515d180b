"""Glue between the driver tables and the operators' input schemas.

The driver tables carry no document dates and no word for each embedding.
Both are bound by fixed rules (also written in the oracle SQL):

- date of a document: ``date_add(DATE '2024-01-01', doc_id % 30)``;
- word of an embedding: the cleaned vocabulary ranked by (total count desc,
  word asc); the word at 0-based rank r is the word of ``vec_id = r``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.ranking import with_global_index

DATE_ORIGIN = "2024-01-01"
DATE_SPAN = 30


def with_document_date(df: DataFrame, id_col: str = "doc_id", date_col: str = "date") -> DataFrame:
    return df.withColumn(date_col, F.date_add(F.lit(DATE_ORIGIN).cast("date"),
                                              (F.col(id_col) % DATE_SPAN).cast("int")))


def ranked_vocabulary(counts: DataFrame, word_col: str = "word", count_col: str = "cnt") -> DataFrame:
    """``(word_rank, ngram, total)``: vocabulary in (total desc, word asc) order."""
    totals = counts.groupBy(F.col(word_col).alias("ngram")).agg(F.sum(count_col).cast("long").alias("total"))
    return with_global_index(totals, [F.col("total").desc(), F.col("ngram").asc()], "word_rank")


def bind_vocabulary(vocab: DataFrame, vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Attach the word of each vector: ``(vec_id, ngram)`` for ranks that have a vector."""
    return vectors.select(id_col).join(
        vocab.select(F.col("word_rank").alias(id_col), "ngram"), id_col)
