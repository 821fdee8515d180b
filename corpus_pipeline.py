"""Corpus pipeline: toxicity, language ID, near duplicates, repeated passages, packing.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame`` over all rows
its predecessor kept; all but the last return the columns of ``documents``.

Null and empty texts: no stage but the language stage drops them (they have no
letter); toxicity gives them the score of a text without words, the near-copies
stage links them with nothing, the cut leaves them as they are, and packing
gives them no piece.  Texts of any length are worked whole.  Rows repeated with
one id and text count once from the near-copies stage on.  An empty table gives
an empty result.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicspark.llm import jaccard_join, langid, packing, repeats, toxicity  # noqa: E402
from topicspark.llm.common import checkpoint, fold, fresh  # noqa: E402
from topicspark.session import prepare  # noqa: E402
from topicspark.sources.tables import read_table  # noqa: E402


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents scored 0.5 or more go."""
    prepare(spark)
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    model = toxicity.train(docs, labels, fold("_id", 5) != 0)
    name = fresh(docs, "_score")
    return toxicity.with_score(docs, model, out_col=name).where(F.col(name) < 0.5).select(*docs.columns)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a recognised language (``und``) go."""
    prepare(spark)
    model = langid.train(docs, fold("_id", 3) != 1)
    name = fresh(docs, "_language")
    got = langid.with_language(docs, model, out_col=name)
    return got.where(F.col(name)["lang"] != "und").select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document of the smallest id of each group of near copies stays."""
    prepare(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: bytes covered by 100-byte strings that start earlier are cut out of the texts."""
    prepare(spark)
    runs = fresh(docs, "_runs")
    got = repeats.cut_text(repeats.find(docs, runs_col=runs), runs_col=runs,
                           chars_col="n_chars" if "n_chars" in docs.columns else None)
    return got.select(*docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the remaining texts as pieces in bins."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near copies", keep_one_of_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack_bins),
]

#: the classifiers of the first two stages have no SQL form; tests/llm holds a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result written and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
