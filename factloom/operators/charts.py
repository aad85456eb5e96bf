"""Widgets (A9-A12) in long form: ``(x, series, value, x_ord, series_ord)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import bucket_start, bucket_text, known_grain
from factloom.functions.naming import value_format
from factloom.functions.rounding import finish, js_round
from factloom.functions.text import category_key, display_string, is_number, is_temporal
from factloom.model import SINGLE_SERIES, WidgetSpec
from factloom.operators.aggregates import (
    effective_aggregation,
    folded,
    merged,
    partial_groups,
    present,
    ranked_names,
    rollup,
    with_names,
)

CHART = "_chart"
SPLIT_LIMIT = 5
BINS = 20
POINTS = "x string, series string, value double, x_ord int, series_ord int"


def _empty(df: DataFrame, schema: str = POINTS) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def _label(df: DataFrame, column: str | None) -> Column:
    if not column or column not in df.columns:
        return F.lit(SINGLE_SERIES)
    return category_key(F.col(column), df.schema[column].dataType)


@dataclass(frozen=True)
class Chart:
    """A widget as the chart functions need it: how its states merge, and its limits."""

    id: str
    kind: str
    aggregation: str
    grain: str | None = None
    limit: int = 8
    split: bool = False

    @staticmethod
    def of(df: DataFrame, spec: WidgetSpec, widget_id: str = "w") -> Chart:
        kind = effective_aggregation(df, spec.y, spec.aggregation)
        limit = spec.limit or (6 if spec.chart_type == "donut" else 8)
        split = bool(spec.split and spec.split in df.columns)
        return Chart(widget_id, kind, spec.aggregation, known_grain(spec.time_grain), limit, split)


def _per_chart(charts: list[Chart], pick: Callable[[Chart], Any], make: Callable[[Any], Column]) -> Column:
    """An expression that differs by chart; a single one when they all agree."""
    variants: dict[Any, list[str]] = {}
    for c in charts:
        variants.setdefault(pick(c), []).append(c.id)
    if len(variants) == 1:
        return make(next(iter(variants)))
    return F.coalesce(*(F.when(F.col(CHART).isin(ids), make(v)) for v, ids in variants.items()))


def _value(charts: list[Chart]) -> Column:
    return _per_chart(charts, lambda c: (c.kind, c.aggregation), lambda v: finish(merged(v[0]), v[1]))


# ---------- time ----------


def time_series(df: DataFrame, spec: WidgetSpec, order_by: str | None = None) -> DataFrame:
    """Bucket by series. Missing series of a bucket become 0 for sum and count only."""
    if spec.x not in df.columns or not is_temporal(df.schema[spec.x].dataType):
        return _empty(df)
    chart = Chart.of(df, spec)
    keys = {CHART: F.lit(chart.id), "bucket": bucket_start(F.col(spec.x), spec.time_grain), "series": _label(df, spec.split)}
    return time_points(partial_groups(df, keys, spec.y, spec.aggregation, order_by), [chart]).drop(CHART)


def time_points(groups: DataFrame, charts: list[Chart]) -> DataFrame:
    """A9 for several charts at once, from states per (chart, bucket, series)."""
    value = _value(charts)
    # Buckets are bounded by the calendar, so ranking them per chart is safe.
    place = F.dense_rank().over(Window.partitionBy(CHART).orderBy("bucket")) - 1
    x = _per_chart(charts, lambda c: c.grain, lambda g: bucket_text(F.col("bucket"), g)).alias("x")
    if not any(c.split for c in charts):
        cells = rollup(groups.filter(present("bucket")), value, CHART, "bucket")
        return cells.select(CHART, x, F.lit(SINGLE_SERIES).alias("series"), "value", place.alias("x_ord"), F.lit(0).alias("series_ord"))
    names = ranked_names(rollup(groups, value, CHART, "series"), "series", CHART, {c.id: SPLIT_LIMIT for c in charts})
    kept = with_names(groups.filter(present("bucket", "series")), names, "series", CHART, len(charts))
    cells = rollup(kept, value, CHART, "bucket", folded("series").alias("series"), "series_names")
    by_series = F.map_from_entries(F.collect_list(F.struct("series", "value")))
    buckets = cells.groupBy(CHART, "bucket", "series_names").agg(by_series.alias("cells"))
    points = buckets.select(
        CHART, "bucket", "cells", place.alias("x_ord"), F.posexplode("series_names").alias("rank", "series")
    ).withColumn("present", F.map_contains_key(F.col("cells"), F.col("series")))
    filled = [c.id for c in charts if c.aggregation in ("sum", "count")]
    points = points.filter(F.col("present") | F.col(CHART).isin(filled)) if filled else points.filter("present")
    # First seen along ascending buckets: within one bucket, series with rows lead.
    seen = F.min(F.struct("x_ord", (~F.col("present")).alias("late"), "rank")).over(Window.partitionBy(CHART, "series"))
    order = F.dense_rank().over(Window.partitionBy(CHART).orderBy("seen")) - 1
    return points.withColumn("seen", seen).select(
        CHART,
        x,
        "series",
        F.coalesce(F.col("cells")[F.col("series")], F.lit(0.0)).alias("value"),
        "x_ord",
        order.alias("series_ord"),
    )


# ---------- categories ----------


def category_series(df: DataFrame, spec: WidgetSpec, order_by: str | None = None) -> DataFrame:
    """A10: top categories by split; absent cells are 0 for every aggregate."""
    if spec.x not in df.columns:
        return _empty(df)
    chart = Chart.of(df, spec)
    keys = {CHART: F.lit(chart.id), "x": _label(df, spec.x), "series": _label(df, spec.split)}
    return category_points(partial_groups(df, keys, spec.y, spec.aggregation, order_by), [chart]).drop(CHART)


def category_points(groups: DataFrame, charts: list[Chart]) -> DataFrame:
    """A10 for several charts at once, from states per (chart, x, series).

    x ranks by value, the split by row count; rows without a split still count for
    the ranking of x.
    """
    value = _value(charts)
    categories = ranked_names(rollup(groups, value, CHART, "x"), "x", CHART, {c.id: c.limit for c in charts})
    kept = with_names(groups.filter(present("x")), categories, "x", CHART, len(charts))
    x_ord = (F.array_position("x_names", folded("x")) - 1).cast("int").alias("x_ord")
    if not any(c.split for c in charts):
        cells = rollup(kept, value, CHART, folded("x").alias("x"), x_ord)
        return cells.select(CHART, "x", F.lit(SINGLE_SERIES).alias("series"), "value", "x_ord", F.lit(0).alias("series_ord"))
    by_rows = rollup(groups, F.lit(0.0), CHART, "series")
    splits = ranked_names(by_rows, "series", CHART, {c.id: SPLIT_LIMIT for c in charts}, by_rows=True)
    kept = with_names(kept, splits, "series", CHART, len(charts))
    cells = rollup(kept, value, CHART, folded("x").alias("x"), x_ord, folded("series").alias("series"), "series_names")
    entry = F.when(F.col("series").isNotNull(), F.struct("series", "value"))
    rows = cells.groupBy(CHART, "x", "x_ord", "series_names").agg(F.map_from_entries(F.collect_list(entry)).alias("cells"))
    return rows.select(CHART, "x", "x_ord", "cells", F.posexplode("series_names").alias("series_ord", "series")).select(
        CHART, "x", "series", F.coalesce(F.col("cells")[F.col("series")], F.lit(0.0)).alias("value"), "x_ord", "series_ord"
    )


# ---------- numbers ----------


def histogram_bounds(df: DataFrame, column: str) -> DataFrame:
    """One row: lowest and highest value and whether every value is integral."""
    c = F.col(column).cast("double")
    return df.agg(
        F.struct(
            F.min(c).alias("lo"), F.max(c).alias("hi"), F.bool_and(c == F.floor(c)).alias("integral")
        ).alias("bounds")
    )


def histogram_shape(bounds: Column) -> tuple[Column, Column, Column]:
    """``(lo, bins, width)``: unit bins for a narrow integer range, else 20 equal ones."""
    lo, span = bounds["lo"], bounds["hi"] - bounds["lo"]
    narrow = bounds["integral"] & (span < BINS)
    bins = F.when(narrow, (span + 1).cast("int")).otherwise(F.lit(BINS))
    width = F.when(narrow, F.lit(1.0)).otherwise(F.coalesce(F.nullif(span, F.lit(0.0)), F.lit(1.0)) / BINS)
    return lo, bins, width


def histogram_bin(c: Column, bounds: Column) -> Column:
    """The bin of a value; the last bin is closed."""
    lo, bins, width = histogram_shape(bounds)
    return F.least(F.floor((c.cast("double") - lo) / width).cast("int"), bins - 1)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``(x, x2, value, x_ord)`` with a row for every bin, empty ones included."""
    if column not in df.columns or not is_number(df.schema[column].dataType):
        return _empty(df, "x double, x2 double, value double, x_ord int")
    bounds = histogram_bounds(df, column)
    counts = (
        df.filter(F.col(column).isNotNull())
        .select(F.col(column).alias("v"), bounds.scalar().alias("bounds"))
        .select(histogram_bin(F.col("v"), F.col("bounds")).alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return histogram_of(counts, bounds)


def histogram_of(counts: DataFrame, bounds: DataFrame) -> DataFrame:
    """A11 from counts per bin and the one-row bounds."""
    lo, bins, width = histogram_shape(F.col("bounds"))
    grid = bounds.filter(F.col("bounds.lo").isNotNull()).select(
        lo.alias("lo"), width.alias("width"), F.explode(F.sequence(F.lit(0), bins - 1)).alias("bin")
    )
    edge = [js_round(F.col("lo") + (F.col("bin") + step) * F.col("width"), 2) for step in (0, 1)]
    return grid.join(counts, "bin", "left").select(
        edge[0].alias("x"),
        edge[1].alias("x2"),
        F.coalesce(F.col("n").cast("double"), F.lit(0.0)).alias("value"),
        F.col("bin").alias("x_ord"),
    )


# ---------- dispatch ----------


def _formats(specs: dict[str, WidgetSpec], chart: Column) -> tuple[Column, Column]:
    """Value format and, for histograms, x format of each chart; names are known on the driver."""
    value, x = [], []
    for widget_id, spec in specs.items():
        histogram_chart = spec.chart_type == "histogram"
        value.append(F.when(chart == widget_id, F.lit("number") if histogram_chart else value_format(F.lit(spec.y or ""), spec.aggregation)))
        if histogram_chart:
            x.append(F.when(chart == widget_id, value_format(F.lit(spec.x), "sum")))
    return F.coalesce(*value), (F.coalesce(*x) if x else F.lit(None).cast("string"))


def with_format(points: DataFrame, specs: dict[str, WidgetSpec]) -> DataFrame:
    """The common result shape of every chart type, so that results can be unioned."""
    value, x = _formats(specs, F.col(CHART))
    x2 = F.col("x2") if "x2" in points.columns else F.lit(None).cast("string")
    return points.select(
        F.col(CHART).alias("widget_id"), "x", x2.alias("x2"), "series", "value", "x_ord", "series_ord", value.alias("format"), x.alias("x_format")
    )


def histogram_points(bins: DataFrame, widget_id: str) -> DataFrame:
    """A histogram in the shape of the other charts: edges as text, one series."""
    double = bins.schema["x"].dataType
    return bins.select(
        F.lit(widget_id).alias(CHART),
        display_string(F.col("x"), double).alias("x"),
        display_string(F.col("x2"), double).alias("x2"),
        F.lit(SINGLE_SERIES).alias("series"),
        "value",
        "x_ord",
        F.lit(0).alias("series_ord"),
    )


def run_widget(df: DataFrame, spec: WidgetSpec, widget_id: str = "w", order_by: str | None = None) -> DataFrame:
    """The chart of one spec, with its value format."""
    if spec.chart_type in ("line", "area"):
        points = time_series(df, spec, order_by).withColumn(CHART, F.lit(widget_id))
    elif spec.chart_type in ("bar", "donut"):
        points = category_series(df, spec, order_by).withColumn(CHART, F.lit(widget_id))
    else:
        points = histogram_points(histogram(df, spec.x), widget_id)
    return with_format(points, {widget_id: spec})
