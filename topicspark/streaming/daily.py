"""Daily word counts of arriving documents (Structured Streaming).

Every micro-batch counts its own documents (T1-T3, T8) and writes the partial
``(date, word, cnt)`` under its batch id; writing a batch again replaces it, so
a retry after a failure is safe.  The daily counts are the sums over all
batches, taken on read.  Nothing waits for a day to close and no document is
late: there is no watermark and no state besides the sink.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators import text as T
from topicspark.session import ensure_checkpoint_dir

PARTIAL_SCHEMA = "date date, word string, word_freq bigint"


def partial_daily_counts(batch: DataFrame, date_col: str = "date", text_col: str = "text") -> DataFrame:
    """``(date, word, word_freq)`` of one micro-batch; rows without a date are dropped."""
    tokens = batch.where(F.col(date_col).isNotNull()).select(
        F.col(date_col).alias("date"), F.explode(T.split_words(F.col(text_col))).alias("token"))
    return (T.remove_stopwords(tokens).groupBy("date", F.col("token").alias("word"))
            .agg(F.count(F.lit(1)).alias("word_freq")))


def total_daily_counts(spark: SparkSession, sink: str) -> DataFrame:
    """The sums over all written batches."""
    return (spark.read.schema(PARTIAL_SCHEMA).option("recursiveFileLookup", "true").parquet(sink)
            .groupBy("date", "word").agg(F.sum("word_freq").cast("long").alias("word_freq")))


def run_available_now(spark: SparkSession, source: str, schema: str, dated, name: str = "daily",
                      files_per_trigger: int | None = None) -> DataFrame:
    """Run the stream over everything now in ``source`` (a folder of Parquet
    files, or a pattern) and return the daily counts.  ``dated`` adds the
    column ``date`` to the source's rows."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)

    def write(batch: DataFrame, batch_id: int) -> None:
        partial_daily_counts(batch).write.mode("overwrite").parquet(f"{base}/out/{batch_id:012d}")

    spark.createDataFrame([], PARTIAL_SCHEMA).write.parquet(f"{base}/out/none")   # a sink also for no input
    query = (dated(reader.parquet(source)).writeStream.foreachBatch(write)
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return total_daily_counts(spark, f"{base}/out")
