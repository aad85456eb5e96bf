"""Request shapes: plain dataclasses, accepted wherever an operator takes options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

# The vocabulary of requests and results.
COLUMN_TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "id")
CHART_TYPES = ("line", "area", "bar", "donut", "histogram")
AGGREGATIONS = ("sum", "avg", "count", "min", "max", "count_distinct")
GRAINS = ("hour", "day", "week", "month")
PAGE_SIZES = (25, 50, 100, 250)
OTHER = "Other"
SINGLE_SERIES = "value"


@dataclass(frozen=True)
class DateRange:
    column: str
    start: str | None = None
    end: str | None = None


@dataclass(frozen=True)
class WhereIn:
    column: str
    values: Sequence[Any] = ()


@dataclass(frozen=True)
class Filters:
    date_range: DateRange | None = None
    where: Sequence[WhereIn] = field(default_factory=tuple)

    @staticmethod
    def from_json(body: Mapping[str, Any] | None) -> Filters:
        """From the request form ``{dateRange: {column, from, to}, where: [...]}``."""
        body = body if isinstance(body, Mapping) else {}
        span = body.get("dateRange")
        wheres = body.get("where")
        return Filters(
            DateRange(span["column"], span.get("from"), span.get("to"))
            if isinstance(span, Mapping) and span.get("column")
            else None,
            tuple(
                WhereIn(w["column"], tuple(w.get("values") or ()))
                for w in (wheres if isinstance(wheres, (list, tuple)) else ())
                if isinstance(w, Mapping) and w.get("column")
            ),
        )


@dataclass(frozen=True)
class WidgetSpec:
    chart_type: str
    x: str
    aggregation: str = "count"
    y: str | None = None
    title: str = ""
    split: str | None = None
    time_grain: str | None = None
    limit: int | None = None

    @staticmethod
    def from_json(body: Mapping[str, Any]) -> WidgetSpec:
        return WidgetSpec(
            body["chartType"],
            body["x"],
            body["aggregation"],
            body.get("y"),
            body.get("title", ""),
            body.get("split"),
            body.get("timeGrain"),
            body.get("limit"),
        )
