"""Confusion counts and the ratios built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, or 0.0 where the denominator is 0."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def align(predicted: DataFrame, truth: DataFrame, on: Sequence[str], strict: bool = False) -> DataFrame:
    """Pair ``predicted`` and ``truth`` flags by position.

    The default keeps positions both sides have. ``strict`` keeps all and marks the
    rows without a partner in ``unmatched``.
    """
    if not strict:
        return predicted.join(truth, list(on))
    both = predicted.select(*on, "predicted").unionByName(truth.select(*on, "truth"), allowMissingColumns=True)
    merged = both.groupBy(*on).agg(F.max("predicted").alias("predicted"), F.max("truth").alias("truth"))
    return merged.withColumn("unmatched", F.col("predicted").isNull() | F.col("truth").isNull())


def evaluate(flags: DataFrame, predicted: str = "predicted", truth: str = "truth") -> DataFrame:
    """One row: precision, recall, f1, accuracy, tp, fp, fn, tn."""
    p, t = F.col(predicted), F.col(truth)
    counts = flags.agg(
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(~p & ~t).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = F.col("precision"), F.col("recall")
    return (
        counts.withColumn("precision", guarded_ratio(tp, tp + fp))
        .withColumn("recall", guarded_ratio(tp, tp + fn))
        .withColumn("f1", guarded_ratio(2 * precision * recall, precision + recall))
        .withColumn("accuracy", guarded_ratio(tp + tn, tp + fp + fn + tn))
        .select("precision", "recall", "f1", "accuracy", "tp", "fp", "fn", "tn")
    )
