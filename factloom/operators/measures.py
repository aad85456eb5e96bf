"""Measure heuristics over a catalog's profile table (H1-H5), all datasets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factloom.functions.naming import (
    default_aggregation,
    entity_label,
    flag_noun,
    humanize,
    is_flag,
    measure_label,
    measure_tier,
    phrase,
    value_format,
)


# A dataset's columns are its schema: bounded, so ranking them per dataset is safe.
def per_dataset(*order: Column | str) -> WindowSpec:
    window = Window.partitionBy("dataset_id")
    return window.orderBy(*order) if order else window


def rank_measures(profiles: DataFrame) -> DataFrame:
    """H1: numeric columns with more than one value, most telling names first, with ``rank``."""
    tier = measure_tier(F.col("name"))
    return (
        profiles.filter((F.col("type") == "numeric") & (F.col("distinct_count") > 1))
        .withColumn("tier", tier)
        .withColumn("rank", F.row_number().over(per_dataset("tier", "position")))
    )


def flag_columns(profiles: DataFrame) -> DataFrame:
    """H2: booleans worth tracking, by position, with ``rank``."""
    return profiles.filter((F.col("type") == "boolean") & is_flag(F.col("name"))).withColumn(
        "rank", F.row_number().over(per_dataset("position"))
    )


def column_labels(profiles: DataFrame) -> DataFrame:
    """H3-H5: default aggregation, format and every label of each column."""
    name = F.col("name")
    aggregation = default_aggregation(name)
    return profiles.select(
        "dataset_id",
        "name",
        aggregation.alias("aggregation"),
        value_format(name, aggregation).alias("format"),
        humanize(name).alias("title"),
        phrase(name).alias("phrase"),
        flag_noun(name).alias("flag_noun"),
        measure_label(name, aggregation).alias("measure_label"),
        entity_label(name).alias("entity_label"),
    )
