"""Streaming daily counts against the batch result; the driver contract."""

import pytest

from testpaths import SF_SMALL


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    """All days, whatever the number of files and micro-batches."""
    from topicspark.plans.registry import all_queries
    from topicspark.sources import bindings
    from topicspark.streaming.daily import run_available_now
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs.repartition(files).write.parquet(f"{tmp_path}/documents.parquet")
    got = run_available_now(spark, f"{tmp_path}/documents.parque[t]", docs.schema, bindings.with_document_date,
                            files_per_trigger=1)
    batch = all_queries()["daily_word_freq"](spark, SF_SMALL)
    assert {(r.date, r.word): r.word_freq for r in got.collect()} == \
        {(r.date, r.word): r.word_freq for r in batch.collect()}


def test_stream_query_reads_a_single_file(spark):
    from topicspark.plans.registry import all_queries
    qs = all_queries()
    stream, batch = qs["stream_daily_word_freq"](spark, SF_SMALL), qs["daily_word_freq"](spark, SF_SMALL)
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty()


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert set(df.columns) == {"cluster_id", "document", "loading"}
    assert df.count() > 0
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 45
