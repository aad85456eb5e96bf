"""Exact counts of the values of several columns, in the columns' own types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slots(cells: DataFrame) -> dict[str, str]:
    """The column of ``whole_counts`` that holds the values of a type."""
    return {t: f"v_{t}" for _, t in cells.dtypes}


def name_of(names: list[str]) -> Column:
    """The name at a ``place``."""
    return F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1)


def whole_counts(cells: DataFrame) -> DataFrame:
    """``(place, v_<type> ..., count, minus)``: each value of the column at a place once, nulls left out.

    A column is counted by its own values alone, which costs far less than cells of all columns under one key: what few
    values a task meets stays small, and only distinct values are shuffled. Doubles that are equal are one
    value; ``minus`` tells how many of a zero are written -0.0.
    """
    named = cells.toDF(*(f"_{i}" for i in range(len(cells.columns))))
    found = None
    for place, (name, kind) in enumerate(named.dtypes):
        counted = [F.count(F.lit(1)).alias("count")]
        if kind == "double":
            counted.append(F.count_if((F.col(name) == 0) & F.col(name).cast("string").startswith("-")).alias("minus"))
        counts = named.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(*counted)
        held = (F.col("v").alias(slot) if t == kind else F.lit(None).cast(t).alias(slot) for t, slot in slots(named).items())
        minus = F.col("minus") if kind == "double" else F.lit(0).cast("long").alias("minus")
        told = counts.select(F.lit(place).alias("place"), *held, "count", minus)
        found = told if found is None else found.unionByName(told)
    return found
