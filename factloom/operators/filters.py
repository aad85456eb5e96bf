"""Filters (Q1-Q3) and date presets (Q5)."""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import display_string, is_temporal
from factloom.model import DateRange, Filters, WhereIn

PRESET_DAYS = {"7d": 7, "30d": 30, "90d": 90}
ISO_DAY = re.compile(r"^\d{4}-\d{2}-\d{2}$", re.ASCII)
STAMP = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$", re.ASCII)


def _day(text: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text[:10])
    except ValueError:
        return None


def _bound(c: Column, dtype: T.DataType, text: str, lower: bool) -> Column:
    """An inclusive day bound in the column's own type, so that it reaches the scan."""
    day = _day(text)
    if day is None:
        shown = F.date_format(c, "yyyy-MM-dd")
        return shown >= text if lower else shown <= text
    if isinstance(dtype, T.DateType):
        return c >= F.lit(day) if lower else c <= F.lit(day)
    if lower:
        return c >= F.lit(day.isoformat()).cast(dtype)
    if day == datetime.date.max:
        return c.isNotNull()
    following = day + datetime.timedelta(days=1)
    return c < F.lit(following.isoformat()).cast(dtype)


def date_condition(df: DataFrame, span: DateRange | None) -> Column | None:
    """Q1 as a condition; None when the filter does nothing."""
    if span is None or not (span.start or span.end) or span.column not in df.columns:
        return None
    dtype = df.schema[span.column].dataType
    if not is_temporal(dtype):
        return F.lit(False)
    c = F.col(span.column)
    condition = c.isNotNull()
    if span.start:
        condition = condition & _bound(c, dtype, span.start, lower=True)
    if span.end:
        condition = condition & _bound(c, dtype, span.end, lower=False)
    return condition


def _typed_values(values: list[str], dtype: T.DataType) -> list | None:
    """The values in the column's type, when display text and value map one to one."""
    if isinstance(dtype, T.StringType):
        return values
    if isinstance(dtype, T.IntegralType):
        bits = {"byte": 7, "short": 15, "integer": 31, "long": 63}[dtype.typeName()]
        parsed = [int(v) for v in values if re.fullmatch(r"-?[0-9]{1,19}", v) and str(int(v)) == v]
        return [v for v in parsed if -(2**bits) <= v < 2**bits]
    if isinstance(dtype, T.DateType):
        return [_day(v) for v in values if ISO_DAY.match(v) and _day(v)]
    if isinstance(dtype, T.BooleanType):
        return [v == "true" for v in values if v in ("true", "false")]
    return None


def _double_spans(c: Column, values: list[str]) -> Column | None:
    """Narrow ranges around the numbers that the texts stand for; None where a text stands for no finite number.

    A double's text has at most twelve decimals, or all digits of an integer: it lies that close to the number it shows.
    """
    spans = F.lit(False)
    for v in values:
        try:
            x = float(v)
        except ValueError:
            continue
        if not math.isfinite(x):
            return None
        reach = 1e-12 + abs(x) * 2.0**-50
        spans = spans | c.between(x - reach, x + reach)
    return spans


def _stamp_spans(c: Column, dtype: T.DataType, values: list[str]) -> Column | None:
    """The milliseconds that the texts stand for; None where one may be of a year beyond four digits."""
    spans = F.lit(False)
    for v in values:
        if v[:1] in ("+", "-"):
            return None
        if not STAMP.match(v):
            continue
        try:
            start = datetime.datetime.fromisoformat(v[:-1])
        except ValueError:
            continue
        if start.year == 9999:
            return None  # its end may have no date
        end = start + datetime.timedelta(milliseconds=1)
        spans = spans | ((c >= F.lit(start.isoformat(" ")).cast(dtype)) & (c < F.lit(end.isoformat(" ")).cast(dtype)))
    return spans


def where_condition(df: DataFrame, where: WhereIn) -> Column | None:
    """Q2 as a condition on the display text; None when the filter does nothing."""
    values = [str(v) for v in where.values or ()]
    if not values or where.column not in df.columns:
        return None
    dtype = df.schema[where.column].dataType
    c = F.col(where.column)
    typed = _typed_values(values, dtype)
    if typed is None:
        shown = display_string(c, dtype).isin(values)
        # Ranges reach the scan; the text has the last word.
        spans = None
        if isinstance(dtype, T.DoubleType):
            spans = _double_spans(c, values)
        elif is_temporal(dtype):
            spans = _stamp_spans(c, dtype, values)
        return shown if spans is None else spans & shown
    return c.isin(typed) if typed else F.lit(False)


def filter_date_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Q1: rows whose UTC day lies within the inclusive bounds."""
    condition = date_condition(df, DateRange(column, start, end))
    return df if condition is None else df.filter(condition)


def filter_where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    """Q2: rows whose display text is one of ``values``; null never matches."""
    condition = where_condition(df, WhereIn(column, values))
    return df if condition is None else df.filter(condition)


def clean_filters(df: DataFrame, filters: Filters | None, date_column: str | None) -> Filters:
    """Q3: the date range moved to the table's date column, useless parts dropped."""
    filters = filters or Filters()
    span = filters.date_range
    kept = None
    if span and date_column and (span.start or span.end):
        kept = DateRange(date_column, span.start, span.end)
    where = tuple(w for w in filters.where if w.column in df.columns and w.values)
    return Filters(kept, where)


def apply_filters(df: DataFrame, filters: Filters | None) -> DataFrame:
    """Q3: the date range and every where-in, all at once."""
    if filters is None:
        return df
    conditions = [date_condition(df, filters.date_range), *(where_condition(df, w) for w in filters.where)]
    for condition in conditions:
        if condition is not None:
            df = df.filter(condition)
    return df


def latest_day(df: DataFrame, column: str) -> datetime.date | None:
    """The data's latest UTC day: one aggregate over one column."""
    return df.agg(F.max(column).cast("date")).first()[0]


def resolve_date_range(
    df: DataFrame, column: str | None, preset: str, start: str | None = None, end: str | None = None
) -> DateRange | None:
    """Q5: the range a preset stands for, anchored on the data's latest day."""
    if preset == "custom":
        if not (column and start and end and ISO_DAY.match(start) and ISO_DAY.match(end)):
            return None
        return DateRange(column, min(start, end), max(start, end))
    if preset == "all" or not column or column not in df.columns:
        return None
    latest = latest_day(df, column)
    if latest is None:
        return None
    if preset == "ytd":
        first = latest.replace(month=1, day=1)
    else:
        first = latest - datetime.timedelta(days=PRESET_DAYS[preset] - 1)
    return DateRange(column, first.isoformat(), latest.isoformat())
