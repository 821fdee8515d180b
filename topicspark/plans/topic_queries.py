"""Registered queries over the topic and report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.operators import cluster as C
from topicspark.operators import text as T
from topicspark.operators import topics as TP
from topicspark.operators import report as R
from topicspark.plans.cluster_queries import CLUSTER_SIZE, HIER_K, HIER_THRESHOLD, SEEDS, unit
from topicspark.plans.registry import register
from topicspark.session import checkpoint
from topicspark.sources import bindings, tables

N_TOPICS = 2


def topic_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``(counts (document, ngram, count), word_clusters (ngram, cluster_id))``
    for the sequential clusters: documents cleaned and counted, the cleaned
    vocabulary bound to the vectors, vectors clustered."""
    counts = checkpoint(T.clean_word_counts(tables.documents(spark, sf_dir))
                        .select(F.col("doc_id").alias("document"), F.col("word").alias("ngram"),
                                F.col("cnt").alias("count")))
    u = unit(spark, sf_dir)
    words = bindings.bind_vocabulary(
        bindings.ranked_vocabulary(counts, word_col="ngram", count_col="count"), u)
    members = C.sequential_cluster(u, CLUSTER_SIZE)
    return counts, checkpoint(C.word_cluster(members, words))


def method_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts and the word-cluster table with a column for each method."""
    counts = checkpoint(T.clean_word_counts(tables.documents(spark, sf_dir))
                        .select(F.col("doc_id").alias("document"), F.col("word").alias("ngram"),
                                F.col("cnt").alias("count")))
    u = unit(spark, sf_dir)
    words = bindings.bind_vocabulary(
        bindings.ranked_vocabulary(counts, word_col="ngram", count_col="count"), u)
    edges = checkpoint(C.neighbor_lists(u, CLUSTER_SIZE))   # both methods walk the same lists
    methods = {"sequential": C.sequential_cluster(u, CLUSTER_SIZE, edges=edges),
               "seeded": C.seeded_cluster(u, SEEDS, CLUSTER_SIZE, edges=edges)}
    return counts, checkpoint(C.word_cluster_table(methods, words))


def hier_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts and the words of the hierarchical clusters."""
    counts = checkpoint(T.clean_word_counts(tables.documents(spark, sf_dir))
                        .select(F.col("doc_id").alias("document"), F.col("word").alias("ngram"), F.col("cnt").alias("count")))
    u = unit(spark, sf_dir)
    words = bindings.bind_vocabulary(bindings.ranked_vocabulary(counts, word_col="ngram", count_col="count"), u)
    members, _ = C.hierarchical_cluster(u, HIER_K, HIER_THRESHOLD)
    return counts, checkpoint(C.word_cluster(members, words))


@register("l1_importance_hier")
def l1_importance_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F0-F4 over the hierarchical clusters: cluster total and the sum of shares."""
    return TP.l1_importance(TP.cluster_doc_word(*hier_inputs(spark, sf_dir), distinct=True)).withColumn("share_sum", F.round("share_sum", 6))


@register("lsa_singular_values_hier")
def lsa_singular_values_hier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8/R3 over the hierarchical clusters."""
    counts, wc = hier_inputs(spark, sf_dir)
    return _singular(TP.lsa_topics(wc, TP.cluster_doc_word(counts, wc, distinct=True), N_TOPICS))


@register("lsa_document_topics")
def lsa_document_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 for LSA: one row per document with its loadings on each cluster's
    first topic in cluster order, written ``cluster:loading in hundredths``."""
    res = _lsa(spark, sf_dir)
    got = R.document_topics(res["loadings"].where(F.col("topic") == 1).drop("topic"))
    pairs = F.transform("topics", lambda t: F.concat_ws(":", t["cluster_id"], F.round(t["loading"] * 100).cast("long")))
    return got.select("document", F.size("topics").alias("n_topics"), F.array_join(pairs, " ").alias("loadings"))


@register("word_cluster_table")
def word_cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word with its cluster under every method."""
    return method_inputs(spark, sf_dir)[1]


@register("l1_importance_seeded")
def l1_importance_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F0-F4 over the seeded clusters: cluster total and the sum of shares."""
    counts, wc = method_inputs(spark, sf_dir)
    return TP.l1_importance(TP.cluster_doc_word(counts, wc, "seeded_cluster", distinct=True)) \
        .withColumn("share_sum", F.round("share_sum", 6))


def doc_word(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counts, wc = topic_inputs(spark, sf_dir)
    return TP.cluster_doc_word(counts, wc, distinct=True), wc


@register("cluster_doc_word")
def cluster_doc_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document-word counts restricted to each cluster (long, sparse)."""
    return doc_word(spark, sf_dir)[0]


@register("l1_doc_loading")
def l1_doc_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 document loading per cluster."""
    return TP.l1_doc_loading(doc_word(spark, sf_dir)[0])


@register("l1_topic_words")
def l1_topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word shares within each cluster."""
    return TP.l1_topic_words(doc_word(spark, sf_dir)[0]).withColumn("weight", F.round("weight", 6))


@register("l1_importance")
def l1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster total and the sum of shares."""
    return TP.l1_importance(doc_word(spark, sf_dir)[0]).withColumn("share_sum", F.round("share_sum", 6))


@register("doc_topic_wide")
def doc_topic_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its L1 loadings in cluster order, written
    ``cluster:loading``; clusters not listed have loading 0."""
    # dealt by documents once, which serves both groupings
    got = R.document_topics(TP.l1_doc_loading(doc_word(spark, sf_dir)[0].select("cluster_id", "document", "cnt").repartition("document")))
    pairs = F.transform("topics", lambda t: F.concat_ws(":", t["cluster_id"], t["loading"]))
    return got.select("document", F.size("topics").alias("n_topics"), F.array_join(pairs, " ").alias("loadings"))


@register("topic_words_table")
def topic_words_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: L1 topic-word distribution of each cluster, ranked (long form)."""
    return R.topic_words_long(TP.l1_topic_words(doc_word(spark, sf_dir)[0])) \
        .withColumn("weight", F.round("weight", 6))


@register("lsa_cluster_status")
def lsa_cluster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10 guard: which clusters get an LSA and why not."""
    cdw, wc = doc_word(spark, sf_dir)
    return TP.lsa_status(wc, cdw, N_TOPICS)


def _lsa(spark: SparkSession, sf_dir: str) -> dict:
    cdw, wc = doc_word(spark, sf_dir)
    return TP.lsa_topics(wc, cdw, N_TOPICS)


def _settled(df: DataFrame, res: dict) -> DataFrame:
    """With the column ``converged`` of the cluster."""
    return df.join(res["singular"].groupBy("cluster_id").agg(F.min("converged").alias("converged")), "cluster_id")


@register("lsa_singular_values")
def lsa_singular_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second singular value per cluster."""
    return _singular(_lsa(spark, sf_dir))


def _singular(res: dict) -> DataFrame:
    out = TP.by_topic_columns(res["singular"], "sigma", ("leading_singular", "second_singular"))
    out = out.select("cluster_id", F.round("leading_singular", 4).alias("leading_singular"),
                     F.round("second_singular", 4).alias("second_singular"))
    return _settled(out, res)


@register("lsa_importance")
def lsa_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of the first and second topic per cluster."""
    res = _lsa(spark, sf_dir)
    out = TP.by_topic_columns(res["importance"], "importance", ("leading_importance", "second_importance"))
    out = out.select("cluster_id", F.round("leading_importance", 2).alias("leading_importance"),
                     F.round("second_importance", 2).alias("second_importance"))
    return _settled(out, res)


@register("lsa_topic_words")
def lsa_topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic-word weights, ranked by weight within each topic."""
    res = _lsa(spark, sf_dir)
    return _settled(R.rank_within(res["words"], ["cluster_id", "topic"], [F.round("weight", 9).desc(), F.col("ngram").asc()])
                    .withColumn("weight", F.round("weight", 4)), res)


@register("lsa_doc_loading")
def lsa_doc_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document loadings of the first and second topic."""
    res = _lsa(spark, sf_dir)
    return _settled(res["loadings"].withColumn("loading", F.round("loading", 4)), res)
