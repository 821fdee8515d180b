"""Registered queries over the embedding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators import vectors as V
from topicspark.plans.registry import register
from topicspark.sources import tables

KNN_K = 10          # find_topk default k
CUT = 0.3           # find_topk default similarity threshold
LSH_BITS = 32       # default index size: 8 bits per table x 4 tables
SAMPLE_M = 100
RECALL_QUERIES = 1000
TUNING_TARGET = 0.5


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unit_vectors(tables.embeddings(spark, sf_dir))


@register("unit_norm")
def unit_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-length embeddings, one row per component."""
    return _unit(spark, sf_dir).select("vec_id", F.posexplode("v").alias("dim", "value")) \
        .withColumn("value", F.round("value", 6))


@register("knn_exact")
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine top-10 of every vector (itself first)."""
    return V.knn_exact(_unit(spark, sf_dir), KNN_K).withColumn("sim", F.round("sim", 6))


@register("nearest_neighbor")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: nearest other vector of every vector."""
    return V.nearest_other(_unit(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@register("query_sample")
def query_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded sample of query points without replacement."""
    return V.query_sample(_unit(spark, sf_dir), SAMPLE_M, seed=42)


@register("lsh_signature")
def lsh_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit sign signatures, one row per 32-bit word."""
    sigs = V.lsh_signatures(_unit(spark, sf_dir), LSH_BITS)
    return sigs.select("vec_id", F.posexplode("sig").alias("word", "bits"))


@register("knn_hamming")
def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 by Hamming distance over 32-bit signatures."""
    return V.knn_hamming(V.lsh_signatures(_unit(spark, sf_dir), LSH_BITS), KNN_K)


@register("topk_threshold")
def topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hamming top-10 lists truncated at the first cosine below 0.3."""
    unit = _unit(spark, sf_dir)
    ranked = V.knn_hamming(V.lsh_signatures(unit, LSH_BITS, keep=True), KNN_K)
    return (V.topk_threshold(ranked.select("q", "n", "rnk", "sim"), CUT, "prefix")
            .withColumn("sim", F.round("sim", 6)))


@register("index_recall")
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the 32-bit Hamming nearest neighbour against the exact one."""
    return V.index_recall(_unit(spark, sf_dir), [LSH_BITS], RECALL_QUERIES, seed=42) \
        .withColumn("accuracy", F.round("accuracy", 6))


@register("lsh_tuning")
def lsh_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index sizes in search order up to the first with accuracy 0.5."""
    return (V.lsh_tuning(_unit(spark, sf_dir), TUNING_TARGET, n_queries=RECALL_QUERIES)
            .withColumn("accuracy", F.round("accuracy", 6)))


@register("lsh_tuning_full")
def lsh_tuning_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search, at the operator's own target of 0.9; no size is too large."""
    return V.lsh_tuning(_unit(spark, sf_dir), n_queries=RECALL_QUERIES).withColumn("accuracy", F.round("accuracy", 6))


@register("zero_vectors")
def zero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings without a direction, which the other operators leave out."""
    return V.zero_vectors(tables.embeddings(spark, sf_dir))


@register("topk_queries")
def topk_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-10 of every vector whose id is divisible by 100, against all."""
    u = _unit(spark, sf_dir)
    return V.find_topk(u.where(F.col("vec_id") % 100 == 0), u, KNN_K).withColumn("sim", F.round("sim", 6))
