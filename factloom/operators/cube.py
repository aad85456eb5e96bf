"""The analysis cube: every aggregate the facts need, from one scan of the table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.calendar import bucket_start, bucket_text
from factloom.functions.rounding import finish, mean
from factloom.functions.text import display_string
from factloom.operators.aggregates import aggregate_column, number_column

ALL = "*"  # the pseudo-category that keeps rows without a category


@dataclass(frozen=True)
class Subject:
    """What the facts talk about: a measure and its aggregation, and a flag."""

    date: str | None
    measure: str | None
    aggregation: str
    flag: str | None = None


def analysis_cube(
    df: DataFrame, subject: Subject, grain: str, categories: list[str], order_by: str | None = None
) -> DataFrame:
    """States per ``(bucket, category, key)`` at the finest grain needed.

    Categories are unpivoted, so one map-side combined shuffle serves every
    candidate column; coarser grains and the whole table are rollups of it. Rows
    without a date keep a null bucket.
    """
    zero = F.lit(None).cast("double")
    first = F.col(order_by) if order_by else F.lit(None).cast("int")
    bucket = bucket_start(F.col(f"`{subject.date}`"), grain) if subject.date else F.lit(None).cast("timestamp")
    # The category columns get positional names, as a category may be called anything.
    shown = {f"_c{i}": display_string(F.col(f"`{c}`"), df.schema[c].dataType) for i, c in enumerate(categories)}
    rows = df.select(
        bucket.alias("bucket"),
        (number_column(df, subject.measure) if subject.measure else zero).alias("_m"),
        (number_column(df, subject.flag) if subject.flag else zero).alias("_f"),
        first.alias("_o"),
        F.lit(ALL).alias("_all"),
        *(c.alias(name) for name, c in shown.items()),
    )
    cells = rows.unpivot(["bucket", "_m", "_f", "_o"], ["_all", *shown], "_column", "key").filter(F.col("key").isNotNull())
    names = F.create_map(F.lit("_all"), F.lit(ALL), *(x for i, c in enumerate(categories) for x in (F.lit(f"_c{i}"), F.lit(c))))
    grouped = cells.groupBy("bucket", "_column", "key").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_m").alias("total"),
        F.count("_m").alias("filled"),
        F.sum("_f").alias("flagged"),
        F.min("_o").alias("first"),
    )
    return grouped.withColumn("category", names[F.col("_column")]).drop("_column")


def cube_value(aggregation: str, flag: bool = False) -> Column:
    """A published value from cube states under a group-by."""
    if flag:
        return finish(F.sum("flagged"), "sum")
    if aggregation == "count":
        return finish(F.sum("rows"), "count")
    if aggregation == "avg":
        return finish(mean(F.sum("total"), F.sum("filled")), "avg")
    return finish(F.sum("total"), "sum")


def cube_series(cube: DataFrame, grain: str, aggregation: str, flag: bool = False) -> DataFrame:
    """F1 from a cube: ``(bucket, value, rows)`` at ``grain`` or coarser than the cube's."""
    whole = cube.filter((F.col("category") == ALL) & F.col("bucket").isNotNull())
    return whole.groupBy(bucket_start(F.col("bucket"), grain).alias("bucket")).agg(
        cube_value(aggregation, flag).alias("value"), F.sum("rows").alias("rows")
    )


def series_by(df: DataFrame, date: str, grain: str, column: str | None, aggregation: str) -> DataFrame:
    """``(bucket, x, value, rows)``: one rounded value per existing bucket."""
    dated = df.filter(F.col(date).isNotNull())
    grouped = dated.groupBy(bucket_start(F.col(date), grain).alias("bucket")).agg(
        finish(aggregate_column(df, column, aggregation), aggregation).alias("value"),
        F.count(F.lit(1)).alias("rows"),
    )
    return grouped.select("bucket", bucket_text(F.col("bucket"), grain).alias("x"), "value", "rows")
