from topicspark.functions.constants import (
    CLEAN_RE,
    CONTRACTION_SPLITS,
    ENGLISH_STOP_WORDS,
    NOUN_SUFFIX_RULES,
    WHITESPACE_RE,
)
from topicspark.functions.vector import as_double_array, dot, l2_norm

__all__ = [
    "CLEAN_RE", "CONTRACTION_SPLITS", "ENGLISH_STOP_WORDS", "NOUN_SUFFIX_RULES",
    "WHITESPACE_RE", "as_double_array", "dot", "l2_norm",
]
