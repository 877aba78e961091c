"""Comparing scoring runs: agreement, consensus, ensembles, id sets.

Cases: a key that only one run has is unmatched, and so is a null key of either; repeated keys pair each with each; a null score agrees with nothing; of no pairs the counts are 0 and the means null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer pairs: key, columns a_* and b_*."""
    named = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c != key))
    return named(a, "a").join(named(b, "b"), key, "full")


def agreement(pairs: DataFrame) -> DataFrame:
    d = F.abs(F.col("a_score") - F.col("b_score"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(d == 0).alias("exact"), F.avg(d).alias("mean_diff"), F.max(d).alias("max_diff"), F.count_if(F.col("a_action") == F.col("b_action")).alias("same_action"),
        F.count_if(F.col("a_score").isNull() | F.col("b_score").isNull()).alias("unmatched"),
    )


def consensus(pairs: DataFrame, key: str) -> DataFrame:
    """The smaller score and confidence of the two; `status` error where either is missing."""
    bad = F.col("a_score").isNull() | F.col("b_score").isNull()
    return pairs.select(key, F.when(~bad, F.least("a_score", "b_score")).alias("score"), F.when(~bad, F.least("a_confidence", "b_confidence")).alias("confidence"), F.when(bad, "error").otherwise("success").alias("status"))


def weighted_ensemble(scores: DataFrame, key: str, score: str, weight: str) -> DataFrame:
    """Weighted mean over the models that have a score; null if none has."""
    return scores.groupBy(key).agg((F.sum(F.col(score) * F.col(weight)) / F.sum(F.when(F.col(score).isNotNull(), F.col(weight)))).alias("ensemble"))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ids only in a, only in b, and whether the sets are equal."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    both = x.join(y, key, "full").agg(F.count_if(F.col("__b").isNull()).alias("only_a"), F.count_if(F.col("__a").isNull()).alias("only_b"))
    return both.withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def field_agreement(pairs: DataFrame, category: str, items: str, number: str) -> DataFrame:
    """Of paired extractions: equal categories, mean Jaccard overlap of lists (1 for two empty ones), mean absolute difference."""
    a, b = F.col(f"a_{items}"), F.col(f"b_{items}")
    union = F.size(F.array_union(a, b))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"a_{category}") == F.col(f"b_{category}")).alias("same_type"),
        F.avg(F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)).alias("overlap"), F.avg(F.abs(F.col(f"a_{number}") - F.col(f"b_{number}"))).alias("distance"),
    )
