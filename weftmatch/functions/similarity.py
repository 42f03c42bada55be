"""Similarities of sentences, and their weighted sum."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EngineConfig


def set_similarity(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays taken as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def cosine(dot: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a dot product and two squared norms; 0 where a norm is 0."""
    return F.when((norm_a > 0) & (norm_b > 0), dot / (F.sqrt(norm_a) * F.sqrt(norm_b))).otherwise(F.lit(0.0))


def dice_bigrams(a: Column, b: Column) -> Column:
    """Dice similarity of the multisets of character pairs, white space removed."""
    plain = lambda t: F.regexp_replace(t, r"\s+", "")
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
    x, y = plain(a), plain(b)
    count = lambda arr, v: F.size(F.filter(arr, lambda e: e == v))
    shared = F.aggregate(F.array_distinct(pairs(x)), F.lit(0), lambda s, g: s + F.least(count(pairs(x), g), count(pairs(y), g)))
    return F.when(x == y, F.lit(1.0)).when((F.length(x) < 2) | (F.length(y) < 2), F.lit(0.0)).otherwise(2.0 * shared / (F.length(x) + F.length(y) - 2))


#: by name, from the columns of a candidate pair
SIMILARITIES: dict[str, Callable[[], Column]] = {
    "jaccard": lambda: set_similarity(F.col("words_a"), F.col("words_b")),
    "winnowing": lambda: set_similarity(F.col("fp_a"), F.col("fp_b")),
    "cosine": lambda: cosine(F.col("dot"), F.col("norm_a"), F.col("norm_b")),
}


def weighted_score(config: EngineConfig) -> Column:
    """Sum of weight times similarity; weights are not rescaled."""
    return sum((F.lit(config.weight(n)) * F.col(n) for n in ("cosine", "winnowing", "jaccard")), F.lit(0.0))
