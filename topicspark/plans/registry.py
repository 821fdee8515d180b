"""Query registry: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicspark.session import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)  # checkpoint folder + package on the workers
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    # importing the plan modules fills the registry
    from topicspark.plans import (  # noqa: F401
        cluster_queries,
        lda_queries,
        text_queries,
        topic_queries,
        vector_queries,
    )
    return dict(QUERIES)
