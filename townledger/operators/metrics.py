"""Aggregates of evaluation: means that a null voids, run summaries, coverage of passages, agreement, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_mean(c: Column) -> Column:
    """The mean, or null for no rows or any null."""
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def run_summary(c: Column, name: str = "") -> list[Column]:
    """Runs, least, median and greatest; the last three are null if any run is null."""
    whole = F.count(F.lit(1)) == F.count(c)
    return [F.count(F.lit(1)).alias(f"{name}runs"), F.when(whole, F.min(c)).alias(f"{name}least"), F.when(whole, F.percentile(c, 0.5)).alias(f"{name}median"), F.when(whole, F.max(c)).alias(f"{name}most")]


def nearest_rank(c: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def kappa(left: Column, right: Column) -> Column:
    """Cohen's kappa of two booleans; null without rows, 1 or 0 where chance agreement is whole."""
    n = F.count(F.lit(1)).cast("double")
    observed = F.sum((left == right).cast("int")) / n
    a, b = F.sum(left.cast("int")) / n, F.sum(right.cast("int")) / n
    chance = a * b + (1 - a) * (1 - b)
    return F.when(n == 0, F.lit(None)).when(chance == 1, F.when(observed == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(observed - chance, 1 - chance))


def covered_length(pairs: DataFrame, passage: list[str], start: str, end: str, left: str, right: str) -> DataFrame:
    """passage columns and covered: how much of [start, end) the union of the intervals [left, right) covers.

    pairs has a row for each interval that meets its passage. A running maximum of the ends is the sweep's cursor.
    """
    cut = pairs.select(*passage, F.greatest(start, left).alias("_cut"), F.col(start).alias("_from"), F.least(end, right).alias("_to"))
    before = Window.partitionBy(*passage).orderBy("_cut", "_to").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("_to") - F.greatest("_cut", F.coalesce(F.max("_to").over(before), F.col("_from"))))
    return cut.withColumn("new", new).groupBy(*passage).agg(F.sum("new").alias("covered"))


def gate(metrics: DataFrame, baseline: DataFrame, tolerance: Column, lower_is_worse: Column) -> DataFrame:
    """metrics (metric, value) against baseline (metric, base): passed is false for a null, or a value beyond its tolerance.

    Quality may fall by an absolute tolerance, cost may rise by a relative one; a value that equals the bound to 1e-12 passes. Metrics
    that the baseline lacks are left out.
    """
    both = baseline.join(metrics, "metric", "left").withColumns({"tolerance": tolerance, "quality": lower_is_worse})
    bound = F.when(F.col("quality"), F.col("base") - F.col("tolerance")).otherwise(F.col("base") * (1 + F.col("tolerance")))
    near = F.abs(F.col("value") - bound) <= F.lit(1e-12) * F.greatest(F.abs("value"), F.abs(bound))
    beyond = F.when(F.col("quality"), F.col("value") < bound).otherwise(F.col("value") > bound)
    return both.select("metric", "value", "base", (F.col("value").isNotNull() & (near | ~beyond)).alias("passed"))
