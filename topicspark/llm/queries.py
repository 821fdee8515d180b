"""Registered queries of the operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.llm import (bpe, embedding_dedup, fingerprints, hpylm, jaccard_join, langid, packing, repeats, sharding, spelling,
                            topk_search, toxicity, vector_codes)
from topicspark.llm.common import fold
from topicspark.session import prepare
from topicspark.sources.tables import read_table

QUERIES: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__doc__, run.__name__ = fn.__doc__, fn.__name__
    QUERIES[fn.__name__] = run
    return fn


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", *(cols or ("text",))])


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of bytes covered by 100-byte strings that also start earlier."""
    got = repeats.cut_column(repeats.find(_docs(spark, sf_dir)))
    return got.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", "_cut.kept_sha256")


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitman-Yor log10 probabilities of all whole texts; learns from the rows whose fold is not 2."""
    got = hpylm.score(_docs(spark, sf_dir), fold("_id", 7) != 2)
    return got.select(F.col("id").alias("doc_id"), F.coalesce(fold("id", 7) == 2, F.lit(True)).alias("held_out"),
                      "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of linked documents over all whole texts (5 words, Jaccard 0.75)."""
    rows, _, comps = jaccard_join.join(_docs(spark, sf_dir), count_links=True)
    got = jaccard_join.with_components(rows, comps)
    return got.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of 2048 words: no two equal texts and at
    most two documents of a source per bin."""
    return packing.pack(_docs(spark, sf_dir, "text", "source"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; learns from the rows whose fold is not 1."""
    docs = _docs(spark, sf_dir, "text", "lang")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(True))
    model = langid.train(docs, fold("_id", 3) != 1)
    got = langid.with_language(docs.select("doc_id", "text"), model, out_col="language")
    return got.select("doc_id", held.alias("held_out"), F.col("language.lang").alias("lang_pred"),
                      F.col("language.score").alias("score"), F.col("language.n_langs").alias("n_langs"))


@query
def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    got = embedding_dedup.dedup(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every whole text and its edited text."""
    got = fingerprints.compare(_docs(spark, sf_dir))
    return got.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
                      fingerprints.as_text("sig").alias("fingerprint"),
                      fingerprints.as_text("edited_sig").alias("edited_fingerprint"),
                      fingerprints.likeness("sig", "edited_sig").alias("near_edited"),
                      fingerprints.likeness("sig", "next_sig").alias("near_next"))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every whole text, and the bytes decoded from them."""
    path, pattern = bpe.defaults()
    got = bpe.with_codes(_docs(spark, sf_dir), path, pattern, digest="ids_digest", decoded="decoded")
    return got.select("doc_id", "ids_digest.n_tokens", "ids_digest.ids_sha256",
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes; equal texts stay together."""
    got = sharding.shard(_docs(spark, sf_dir))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; labels are learnt from the rows whose fold is not 0."""
    docs = _docs(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    model = toxicity.train(docs, labels, fold("_id", 5) != 0)
    got = toxicity.with_score(docs, model)
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(True))
    return got.select("doc_id", held.alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, forms and roots of all words of seven letters and two occurrences or more."""
    return spelling.variants(_docs(spark, sf_dir))


@query
def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every vector whose id 20 divides."""
    return topk_search.top_k(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"]))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by eight codebooks of 16 entries, learnt in six rounds."""
    got, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]))
    return got.select(F.col("id").alias("vec_id"), "code", "error", "label_error",
                      F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express a query; see ``oracle``."""
    from topicspark.llm.oracle import ORACLE
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
