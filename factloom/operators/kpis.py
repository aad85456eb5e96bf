"""The KPI strip (K1-K3): headline numbers with a period-over-period delta."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import day_index
from factloom.functions.naming import default_aggregation, entity_label, flag_noun, is_flag, measure_label, value_format
from factloom.functions.rounding import finish, js_round, mean
from factloom.functions.text import is_temporal
from factloom.model import DateRange, Filters
from factloom.operators.aggregates import aggregate_column, effective_aggregation, number_column
from factloom.operators.filters import apply_filters, date_condition
from factloom.operators.measures import rank_measures

EPOCH = datetime.date(1970, 1, 1)
KPI_LIMIT = 4
WINDOW_DAYS = 30


@dataclass(frozen=True)
class Kpi:
    id: str
    label: str
    column: str | None
    aggregation: str
    format: str
    scale: float = 1.0


@dataclass(frozen=True)
class Windows:
    """Day indexes of the current and the previous window, bounds included."""

    current: tuple[int, int]
    previous: tuple[int, int]
    label: str


def kpi_defs(profiles: DataFrame) -> DataFrame:
    """K1: up to four KPIs per dataset: entities or rows, two measures, one rate."""
    by_position = Window.partitionBy("dataset_id").orderBy("position")
    ids = profiles.filter(F.col("type") == "id").withColumn("_n", F.row_number().over(by_position)).filter("_n = 1")
    entities = ids.select(
        "dataset_id",
        F.lit(0).alias("ord"),
        F.lit("entities").alias("id"),
        entity_label(F.col("name")).alias("label"),
        F.col("name").alias("column"),
        F.lit("count_distinct").alias("aggregation"),
        F.lit("number").alias("format"),
        F.lit(1.0).alias("scale"),
    )
    # Datasets without an id column count rows instead.
    has_id = F.max(F.when(F.col("type") == "id", 1).otherwise(0))
    rows = profiles.groupBy("dataset_id").agg(has_id.alias("_has")).filter("_has = 0").select(
        "dataset_id",
        F.lit(0).alias("ord"),
        F.lit("rows").alias("id"),
        F.lit("Rows").alias("label"),
        F.lit(None).cast("string").alias("column"),
        F.lit("count").alias("aggregation"),
        F.lit("number").alias("format"),
        F.lit(1.0).alias("scale"),
    )
    measured = rank_measures(profiles).filter("rank <= 2").withColumn("aggregation", default_aggregation(F.col("name")))
    measures = measured.select(
        "dataset_id",
        F.col("rank").alias("ord"),
        F.concat(F.lit("m:"), "name").alias("id"),
        measure_label(F.col("name"), F.col("aggregation")).alias("label"),
        F.col("name").alias("column"),
        "aggregation",
        value_format(F.col("name"), F.col("aggregation")).alias("format"),
        F.lit(1.0).alias("scale"),
    )
    flagged = profiles.filter((F.col("type") == "boolean") & is_flag(F.col("name")))
    rates = flagged.withColumn("_n", F.row_number().over(by_position)).filter("_n = 1").select(
        "dataset_id",
        F.lit(3).alias("ord"),
        F.concat(F.lit("rate:"), "name").alias("id"),
        F.concat(flag_noun(F.col("name")), F.lit(" rate")).alias("label"),
        F.col("name").alias("column"),
        F.lit("avg").alias("aggregation"),
        F.lit("percent").alias("format"),
        F.lit(100.0).alias("scale"),
    )
    return entities.unionByName(rows).unionByName(measures).unionByName(rates)


def kpi_list(profiles: DataFrame) -> list[Kpi]:
    """K1 of a single dataset, on the driver: at most four rows."""
    rows = kpi_defs(profiles).orderBy("ord").limit(KPI_LIMIT).collect()
    return [Kpi(r["id"], r["label"], r["column"], r["aggregation"], r["format"], r["scale"]) for r in rows]


def kpi_windows(df: DataFrame, date_column: str | None, filters: Filters | None = None) -> Windows | None:
    """K2: the requested range against the one before, or the data's last days.

    Without both bounds it reads the first and last day of the selected rows.
    """
    if not date_column or date_column not in df.columns or not is_temporal(df.schema[date_column].dataType):
        return None
    span = filters.date_range if filters else None
    if span and span.start and span.end:
        start, end = ((datetime.date.fromisoformat(d[:10]) - EPOCH).days for d in (span.start, span.end))
        length = end - start + 1
        return Windows((start, end), (start - length, start - 1), f"vs previous {length} days")
    low, high = apply_filters(df, filters).agg(
        day_index(F.min(date_column)).alias("low"), day_index(F.max(date_column)).alias("high")
    ).first()
    if low is None:
        return None
    width = min(WINDOW_DAYS, (high - low + 1) // 2)
    if width < 1:
        return None
    return Windows((high - width + 1, high), (high - 2 * width + 1, high - width), f"Last {width} days vs prior {width}")


def _day_text(index: int) -> str:
    return (EPOCH + datetime.timedelta(days=index)).isoformat()


def _masked_values(df: DataFrame, kpis: list[Kpi], masks: dict[str, Column]) -> DataFrame:
    """One row ``<mask><i>``: every KPI under every mask, from one scan.

    With an exact distinct count among them the rows are first reduced per
    counted value; the second step then only counts values and adds states, so
    the several distinct counts do not multiply the rows.
    """
    base = df.select("*", *(m.alias(f"_m_{name}") for name, m in masks.items()))
    kinds = [effective_aggregation(df, k.column, k.aggregation) for k in kpis]
    distinct = list(dict.fromkeys(k.column for k, kind in zip(kpis, kinds) if kind == "count_distinct"))
    if len(distinct) > 1:
        # Rows can be reduced per value of one column only.
        return base.agg(
            *(
                js_round(finish(aggregate_column(df, k.column, k.aggregation, F.col(f"_m_{name}")), k.aggregation) * k.scale, 2).alias(f"{name}{i}")
                for name in masks
                for i, k in enumerate(kpis)
            )
        )
    counted = distinct[0] if distinct else None
    states, results = [], []
    for name in masks:
        mask = F.col(f"_m_{name}")
        for i, (kpi, kind) in enumerate(zip(kpis, kinds)):
            key = f"{name}{i}"
            if kind == "count_distinct":
                states.append(F.bool_or(mask & F.col(kpi.column).isNotNull()).alias(f"_d_{key}"))
                value = F.count_if(f"_d_{key}").cast("double")
            elif kind == "count":
                states.append(F.count_if(mask).alias(f"_n_{key}"))
                value = F.sum(f"_n_{key}").cast("double")
            elif kind == "none":
                value = F.max(F.lit(0.0))
            elif kind in ("sum", "avg"):
                number = F.when(mask, number_column(df, kpi.column))
                states += [F.sum(number).alias(f"_s_{key}"), F.count(number).alias(f"_n_{key}")]
                value = F.sum(f"_s_{key}")
                if kind == "avg":
                    value = mean(value, F.sum(f"_n_{key}"))
            else:
                function = F.min if kind == "min" else F.max
                states.append(function(F.when(mask, number_column(df, kpi.column))).alias(f"_x_{key}"))
                value = function(f"_x_{key}")
            results.append(js_round(finish(value, kpi.aggregation) * F.lit(kpi.scale), 2).alias(key))
    grouped = base.groupBy(counted) if counted else base.groupBy()
    return grouped.agg(*states).agg(*results) if states else base.agg(*results)


def compute_kpis(
    df: DataFrame,
    kpis: list[Kpi] | DataFrame,
    date_column: str | None = None,
    filters: Filters | None = None,
) -> DataFrame:
    """K3: value under all filters; delta between the windows under the where-filters only.

    ``kpis`` is a list of KPIs, or the profiles of the dataset they derive from.
    """
    kpis = kpi_list(kpis) if isinstance(kpis, DataFrame) else kpis
    filters = filters or Filters()
    where_only = apply_filters(df, Filters(None, filters.where))
    windows = kpi_windows(where_only, date_column, Filters(filters.date_range))
    selected = date_condition(df, filters.date_range)
    masks = {"v": F.lit(True) if selected is None else F.coalesce(selected, F.lit(False))}
    if windows:
        day = day_index(F.col(date_column))
        masks["c"] = F.coalesce(day.between(*windows.current), F.lit(False))
        masks["p"] = F.coalesce(day.between(*windows.previous), F.lit(False))
        span = filters.date_range
        if selected is not None and span.column == date_column and span.start and span.end:
            # Only the two windows are ever looked at: let the scan skip the rest.
            reach = DateRange(date_column, _day_text(windows.previous[0]), _day_text(windows.current[1]))
            where_only = apply_filters(where_only, Filters(reach))
    row = _masked_values(where_only, kpis, masks)
    entries = []
    for i, kpi in enumerate(kpis):
        delta = F.lit(None).cast("double")
        if windows:
            current, previous = F.col(f"c{i}"), F.col(f"p{i}")
            delta = js_round((current - previous) / F.abs(F.nullif(previous, F.lit(0.0))), 4)
        entries.append(
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(kpi.id).alias("id"),
                F.lit(kpi.label).alias("label"),
                F.lit(kpi.column).cast("string").alias("column"),
                F.lit(kpi.aggregation).alias("aggregation"),
                F.col(f"v{i}").alias("value"),
                delta.alias("delta"),
                F.when(delta.isNotNull(), F.lit(windows.label if windows else None)).cast("string").alias("delta_label"),
                F.lit(kpi.format).alias("format"),
            )
        )
    return row.select(F.inline(F.array(*entries)))
