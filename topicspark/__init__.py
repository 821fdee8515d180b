"""topicspark: interpretable topic factors from a corpus and word embeddings, on Spark.

Every operator takes DataFrames and returns DataFrames.  Counts stay long and
sparse, clusters are processed together by grouping key, and iterative steps
(greedy clustering, hierarchical merging, subspace iteration, EM) run as a few
rounds of joins and aggregations with reliable checkpoints between rounds.
"""

from topicspark.session import ensure_checkpoint_dir, get_spark

__all__ = ["ensure_checkpoint_dir", "get_spark"]
