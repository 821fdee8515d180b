"""Operations of a training-data pipeline: ten operators, one module each.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
folder (and ``corpus_pipeline.py``, ``tests/llm``) imports it.
"""
