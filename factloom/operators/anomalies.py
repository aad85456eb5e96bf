"""Robust outliers of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import bucket_start

Z_THRESHOLD = 3.5
MAD_SCALE = 1.4826
LEAST_BUCKETS = 8
LEAST_ROWS_SHARE = 0.8
MOST_ANOMALIES = 3


def robust_z(series: DataFrame, key: str | None = None) -> DataFrame:
    """``z`` per value: (v - median) / (1.4826 MAD), the plain z when MAD is 0.

    Series are aggregates with a calendar-bounded number of buckets; ``key`` runs
    many of them at once.
    """
    whole = Window.partitionBy(*([key] if key else []))
    v = F.col("value")
    scored = series.withColumn("_med", F.median("value").over(whole))
    scored = scored.withColumn("_mad", F.median(F.abs(v - F.col("_med"))).over(whole))
    deviation = F.stddev_pop("value").over(whole)
    plain = (v - F.avg("value").over(whole)) / F.when(deviation == 0, 1.0).otherwise(deviation)
    robust = F.try_divide(v - F.col("_med"), MAD_SCALE * F.col("_mad"))
    return scored.withColumn("z", F.when(F.col("_mad") == 0, plain).otherwise(robust)).drop("_med", "_mad")


def anomalies(points: DataFrame, chart_grain: Column, threshold: float = Z_THRESHOLD, most: int = MOST_ANOMALIES) -> DataFrame:
    """the strongest outliers, one per target and chart bucket, at most three.

    ``points`` is ``(target, averaged, bucket, value, rows)``, ``target`` ordered by
    importance. Averages over unusually few rows are not flagged. Adds ``z``,
    ``previous_bucket``, ``chart_bucket`` and ``place``.
    """
    whole = Window.partitionBy("target")
    enough = points.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= LEAST_BUCKETS)
    least = F.when(F.col("averaged"), F.median("rows").over(whole) * LEAST_ROWS_SHARE).otherwise(0.0)
    scored = (
        robust_z(enough, "target")
        .withColumn("_least", least)
        .withColumn("previous_bucket", F.lag("bucket").over(whole.orderBy("bucket")))
        .filter((F.abs("z") >= threshold) & (F.col("rows") >= F.col("_least")))
    )
    strength = [F.abs("z").desc(), F.asc("target"), F.asc("bucket")]
    charted = scored.withColumn("chart_bucket", _coarsened(F.col("bucket"), chart_grain))
    per_point = F.row_number().over(Window.partitionBy("target", "chart_bucket").orderBy(*strength))
    single = charted.withColumn("_first", per_point).filter("_first = 1")
    placed = single.withColumn("place", F.row_number().over(Window.orderBy(*strength)))
    return placed.filter(F.col("place") <= most).drop("_n", "_least", "_first")


def _coarsened(bucket: Column, grain: Column) -> Column:
    return F.coalesce(*(F.when(grain == g, bucket_start(bucket, g)) for g in ("hour", "day", "week", "month")))
