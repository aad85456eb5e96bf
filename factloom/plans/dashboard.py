"""One filtered dashboard request: every widget and the KPIs.

The table is scanned once for all widgets: their keys become grouping sets of one
aggregation, whose result, small next to the table, is kept while the charts are
ranked, folded and filled from it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.calendar import bucket_start, known_grain
from factloom.functions.text import category_key, is_number, is_temporal
from factloom.model import SINGLE_SERIES, Filters, WidgetSpec
from factloom.operators.aggregates import COUNT, FIRST, HIGH, ITEM, LOW, ROWS, SUM, effective_aggregation, number_column
from factloom.operators.charts import (
    CHART,
    Chart,
    category_points,
    histogram_bin,
    histogram_bounds,
    histogram_of,
    histogram_points,
    run_widget,
    time_points,
    with_format,
)
from factloom.operators.filters import apply_filters, clean_filters
from factloom.operators.kpis import Kpi, compute_kpis
from factloom.session import gathered

TIME_CHARTS = ("line", "area")


@dataclass
class DashboardResult:
    points: DataFrame
    kpis: DataFrame | None
    cube: DataFrame | None = None

    def release(self) -> None:
        """Drops the kept aggregation once the results are read."""
        if self.cube is not None:
            self.cube.unpersist()


def _shares_scan(df: DataFrame, spec: WidgetSpec) -> bool:
    """Whether a widget's states can sit in the common aggregation."""
    if spec.x not in df.columns:
        return False
    dtype = df.schema[spec.x].dataType
    if spec.chart_type == "histogram":
        return is_number(dtype)
    if spec.chart_type in TIME_CHARTS and not is_temporal(dtype):
        return False
    return effective_aggregation(df, spec.y, spec.aggregation) != "none"


class _SharedCube:
    """Grouping sets over the deduplicated keys and states of several widgets."""

    def __init__(self, df: DataFrame, specs: list[WidgetSpec], order_by: str | None) -> None:
        self.df, self.order_by = df, order_by
        self.keys: dict[tuple, str] = {}
        self.columns: list[Column] = []
        self.scalars: list[Column] = []
        self.states: dict[str, Column] = {ROWS: F.count(F.lit(1))}
        self.measures: dict[str, str] = {}
        self.bounds: dict[str, DataFrame] = {}
        self.keys_of = [self._keys_of(s) for s in specs]
        # A distinct count merges over its counted values: they are one more key of its grouping set.
        self.items = [self._item_of(s) for s in specs]
        self.sets = [[*keys, item] if item else keys for keys, item in zip(self.keys_of, self.items)]
        for s in specs:
            self._states_of(s)

    def _key(self, identity: tuple, c: Column) -> str:
        if identity not in self.keys:
            self.keys[identity] = f"_k{len(self.keys)}"
            self.columns.append(c.alias(self.keys[identity]))
        return self.keys[identity]

    def _keys_of(self, spec: WidgetSpec) -> list[str]:
        df = self.df
        if spec.chart_type == "histogram":
            bounds = self.bounds.setdefault(spec.x, histogram_bounds(df, spec.x))
            if ("bin", spec.x) not in self.keys:
                self.scalars.append(bounds.scalar().alias(f"_b_{spec.x}"))
            return [self._key(("bin", spec.x), histogram_bin(F.col(spec.x), F.col(f"_b_{spec.x}")))]
        if spec.chart_type in TIME_CHARTS:
            grain = known_grain(spec.time_grain)
            keys = [self._key(("time", spec.x, grain), bucket_start(F.col(spec.x), grain))]
        else:
            keys = [self._key(("label", spec.x), category_key(F.col(spec.x), df.schema[spec.x].dataType))]
        if spec.split and spec.split in df.columns:
            keys.append(self._key(("label", spec.split), category_key(F.col(spec.split), df.schema[spec.split].dataType)))
        return keys

    def _item_of(self, spec: WidgetSpec) -> str | None:
        if spec.chart_type == "histogram" or effective_aggregation(self.df, spec.y, spec.aggregation) != "count_distinct":
            return None
        return self._key(("item", spec.y), F.col(spec.y))

    def _states_of(self, spec: WidgetSpec) -> None:
        kind = effective_aggregation(self.df, spec.y, spec.aggregation)
        if spec.chart_type == "histogram" or kind in ("count", "count_distinct"):
            return
        m = self.measures.setdefault(spec.y, f"_y{len(self.measures)}")
        wanted = {"sum": [(SUM, F.sum)], "avg": [(SUM, F.sum), (COUNT, F.count)], "min": [(LOW, F.min)], "max": [(HIGH, F.max)]}
        for state, function in wanted[kind]:
            self.states[m + state] = function(m)

    def build(self) -> DataFrame:
        names = list(self.keys.values())
        measures = [number_column(self.df, y).alias(m) for y, m in self.measures.items()]
        order = [F.col(self.order_by).alias("_o")] if self.order_by else []
        rows = self.df.select("*", *self.scalars).select(*self.columns, *measures, *order)
        first = F.min("_o") if order else F.max(F.lit(None).cast("int"))
        sets = list(dict.fromkeys(tuple(dict.fromkeys(s)) for s in self.sets))
        states = [c.alias(name) for name, c in self.states.items()]
        grouped = rows.groupingSets([list(s) for s in sets], *names).agg(*states, first.alias(FIRST), F.grouping_id().alias("_set"))
        kept = grouped.persist(StorageLevel.MEMORY_AND_DISK)
        self.cube = gathered(kept)
        return kept

    def _set_of(self, keys: list[str]) -> int:
        names = list(self.keys.values())
        return sum(1 << (len(names) - 1 - i) for i, n in enumerate(names) if n not in keys)

    def histogram(self, i: int, spec: WidgetSpec) -> DataFrame:
        bin_ = F.col(self.sets[i][0])
        counts = self.cube.filter((F.col("_set") == self._set_of(self.sets[i])) & bin_.isNotNull())
        return histogram_of(counts.select(bin_.alias("bin"), F.col(ROWS).alias("n")), self.bounds[spec.x])

    def cells(self, members: list[tuple[int, str, WidgetSpec]], key: str) -> DataFrame:
        """States of several charts as ``(chart, key, series, states)``: a cube row is
        repeated for every chart that reads its grouping set."""
        entries = []
        for i, widget_id, spec in members:
            keys, item = self.keys_of[i], self.items[i]
            m = "" if item else self.measures.get(spec.y, "")
            states = [
                (F.col(m + s) if m + s in self.states else F.lit(None)).cast("bigint" if s == COUNT else "double").alias(s)
                for s in (SUM, COUNT, LOW, HIGH)
            ]
            series = F.col(keys[1]) if len(keys) > 1 else F.lit(SINGLE_SERIES)
            counted = (F.col(item).cast("string") if item else F.lit(None).cast("string")).alias(ITEM)
            entry = F.struct(F.lit(widget_id).alias(CHART), F.col(keys[0]).alias(key), series.alias("series"), *states, counted)
            entries.append(F.when(F.col("_set") == self._set_of(self.sets[i]), entry))
        rows = self.cube.select(ROWS, FIRST, F.explode(F.array_compact(F.array(*entries))).alias("_cell"))
        return rows.select("_cell.*", ROWS, FIRST)


def dashboard_query(
    df: DataFrame,
    widgets: dict[str, WidgetSpec],
    filters: Filters | None = None,
    kpis: list[Kpi] | DataFrame | None = None,
    date_column: str | None = None,
    order_by: str | None = None,
) -> DashboardResult:
    """``points`` of every widget with its ``widget_id``, and the KPI rows.

    Charts of one family are ranked, folded and filled together, so the number of
    Spark jobs does not grow with the number of widgets. Distinct counts share the
    scan too: their grouping set has the counted value as one more key.
    """
    filters = clean_filters(df, filters, date_column)
    filtered = apply_filters(df, filters)
    shared = {i: s for i, s in widgets.items() if _shares_scan(df, s)}
    parts = [run_widget(filtered, s, i, order_by) for i, s in widgets.items() if i not in shared]
    cube = None
    if shared:
        common = _SharedCube(filtered, list(shared.values()), order_by)
        cube = common.build()
        members = [(n, i, s) for n, (i, s) in enumerate(shared.items())]
        families = {
            "bucket": [m for m in members if m[2].chart_type in TIME_CHARTS],
            "x": [m for m in members if m[2].chart_type in ("bar", "donut")],
        }
        for key, family in families.items():
            if family:
                charts = [Chart.of(df, s, i) for _, i, s in family]
                cells = common.cells(family, key)
                points = time_points(cells, charts) if key == "bucket" else category_points(cells, charts)
                parts.append(with_format(points, {i: s for _, i, s in family}))
        for n, i, s in members:
            if s.chart_type == "histogram":
                parts.append(with_format(histogram_points(common.histogram(n, s), i), {i: s}))
    points = None
    for part in parts:
        points = part if points is None else points.unionByName(part)
    strip = None if kpis is None else compute_kpis(df, kpis, date_column, filters)
    return DashboardResult(points, strip, cube)
