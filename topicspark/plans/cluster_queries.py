"""Registered queries over the clustering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators import cluster as C
from topicspark.operators import text as T
from topicspark.operators import vectors as V
from topicspark.plans.registry import register
from topicspark.sources import bindings, tables

CLUSTER_SIZE = 50            # reference default
SEEDS = (7, 3, 400, 123)
HIER_THRESHOLD = 0.3         # 0.5 merges almost nothing on these vectors
HIER_K = 20


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unit_vectors(tables.embeddings(spark, sf_dir))


def vector_words(spark: SparkSession, sf_dir: str, vectors: DataFrame) -> DataFrame:
    """``(vec_id, ngram)``: the cleaned vocabulary bound to the vectors by rank."""
    counts = T.clean_word_counts(tables.documents(spark, sf_dir))
    return bindings.bind_vocabulary(bindings.ranked_vocabulary(counts), vectors)


def seq_members(spark: SparkSession, sf_dir: str, vectors: DataFrame | None = None) -> DataFrame:
    return C.sequential_cluster(vectors if vectors is not None else unit(spark, sf_dir), CLUSTER_SIZE)


@register("seq_cluster")
def seq_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential greedy clusters over exact top-50 lists."""
    return seq_members(spark, sf_dir)


@register("seq_cluster_lsh")
def seq_cluster_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with the hashed index: Hamming top-50 over 32 sign bits, lists cut
    at the first cosine below 0.3."""
    return C.sequential_cluster(unit(spark, sf_dir), CLUSTER_SIZE, method="lsh", cut=0.3)


@register("seeded_cluster")
def seeded_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds 7, 3, 400, 123 first, then sequential."""
    return C.seeded_cluster(unit(spark, sf_dir), SEEDS, CLUSTER_SIZE)


@register("hier_round")
def hier_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: one merge round from singletons, threshold 0.3."""
    u = unit(spark, sf_dir)
    return C.merge_round(C.singletons(u), u, HIER_THRESHOLD)


@register("hier_cluster")
def hier_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge rounds until 20 clusters or fewer than 10 merges."""
    u = unit(spark, sf_dir)
    members, _ = C.hierarchical_cluster(u, HIER_K, HIER_THRESHOLD)
    return members


@register("hier_cluster_lsh")
def hier_cluster_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 with the hashed search while more than 100 clusters remain (the
    reference's own bound is 20 000): Hamming nearest over 256 sign bits."""
    return C.hierarchical_cluster(unit(spark, sf_dir), HIER_K, HIER_THRESHOLD, method="lsh", hash_above=100, nbits=256)[0]


@register("seq_cluster_tuned")
def seq_cluster_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 over the hashed index of the size that the search finds (target 0.5)."""
    return C.sequential_cluster(unit(spark, sf_dir), CLUSTER_SIZE, method="lsh", cut=0.3, nbits=None, target=0.5)


@register("hier_cluster_words")
def hier_cluster_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical cluster -> its words, in numbered pieces of 20."""
    u = unit(spark, sf_dir)
    members, _ = C.hierarchical_cluster(u, HIER_K, HIER_THRESHOLD)
    return C.cluster_word_pieces(C.word_cluster(members, vector_words(spark, sf_dir, u)), 20)


@register("centroids")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit centroids of the sequential clusters, one row per component."""
    u = unit(spark, sf_dir)
    cents = C.centroids(seq_members(spark, sf_dir, u), u)
    return cents.select("cluster_id", F.posexplode("v").alias("dim", "value")) \
        .withColumn("value", F.round("value", 6))


@register("word_cluster")
def word_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word -> sequential cluster."""
    u = unit(spark, sf_dir)
    return C.word_cluster(seq_members(spark, sf_dir, u), vector_words(spark, sf_dir, u))


@register("cluster_words")
def cluster_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential cluster -> its words."""
    u = unit(spark, sf_dir)
    return C.cluster_words(C.word_cluster(seq_members(spark, sf_dir, u), vector_words(spark, sf_dir, u)))
