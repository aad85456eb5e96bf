"""Aggregation.

Grouped aggregates run in two steps. ``partial_groups`` reduces the rows once to
mergeable states per key combination; every ranking and every fold ("Other",
splits) is a ``rollup`` of those states. The table is read and shuffled once,
map-side combined, however many rankings a chart needs, and a hot key is reduced
before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.rounding import finish, mean
from factloom.functions.text import category_key, is_measurable
from factloom.model import OTHER

ROWS, SUM, COUNT, LOW, HIGH, ITEM, FIRST = "_rows", "_sum", "_count", "_low", "_high", "_item", "_first"


def effective_aggregation(df: DataFrame, column: str | None, aggregation: str) -> str:
    """``count`` also stands for a missing column; ``none`` for one without numbers."""
    if aggregation == "count" or not column or column not in df.columns:
        return "count"
    if aggregation == "count_distinct":
        return aggregation
    return aggregation if is_measurable(df.schema[column].dataType) else "none"


def number_column(df: DataFrame, column: str) -> Column:
    """The column as doubles, booleans as 1/0."""
    c = F.col(column)
    if df.schema[column].dataType.typeName() == "boolean":
        c = c.cast("int")
    return c.cast("double")


def aggregate_column(
    df: DataFrame, column: str | None, aggregation: str, mask: Column | None = None
) -> Column:
    """One unrounded aggregate; ``mask`` restricts it, so windows share a scan."""
    kind = effective_aggregation(df, column, aggregation)

    def only(c: Column) -> Column:
        return c if mask is None else F.when(mask, c)

    if kind == "count":
        return F.count(only(F.lit(1))).cast("double")
    if kind == "count_distinct":
        return F.count_distinct(only(F.col(column))).cast("double")
    if kind == "none":
        return F.max(F.lit(0.0))
    numbers = only(number_column(df, column))
    if kind == "avg":
        return F.coalesce(mean(F.sum(numbers), F.count(numbers)), F.lit(0.0))
    return F.coalesce({"sum": F.sum, "min": F.min, "max": F.max}[kind](numbers), F.lit(0.0))


def aggregate(
    df: DataFrame, column: str | None, aggregation: str, mask: Column | None = None
) -> DataFrame:
    """One row, one ``value``, rounded as published."""
    value = finish(aggregate_column(df, column, aggregation, mask), aggregation)
    return df.agg(value.alias("value"))


# ---------- states ----------


def _states(df: DataFrame, column: str | None, kind: str) -> dict[str, Column]:
    states = {ROWS: F.count(F.lit(1))}
    if kind in ("sum", "avg"):
        states[SUM] = F.sum(number_column(df, column))
    if kind == "avg":
        states[COUNT] = F.count(F.col(column))
    if kind == "min":
        states[LOW] = F.min(number_column(df, column))
    if kind == "max":
        states[HIGH] = F.max(number_column(df, column))
    return states


def merged(kind: str) -> Column:
    """The aggregate of merged states."""
    if kind == "count":
        return F.sum(ROWS).cast("double")
    if kind == "count_distinct":
        return F.count_distinct(ITEM).cast("double")
    if kind == "none":
        return F.max(F.lit(0.0))
    if kind == "avg":
        return mean(F.sum(SUM), F.sum(COUNT))
    return {"sum": F.sum(SUM), "min": F.min(LOW), "max": F.max(HIGH)}[kind]


def partial_groups(
    df: DataFrame,
    keys: dict[str, Column],
    column: str | None,
    aggregation: str,
    order_by: str | None = None,
) -> DataFrame:
    """One pass over ``df``: states per combination of the named key columns.

    ``order_by`` names the column giving row order; groups carry its minimum so
    that equal values rank by first appearance. An exact distinct count keeps
    the counted value as one more key, which also spreads hot groups.
    """
    kind = effective_aggregation(df, column, aggregation)
    named = [c.alias(name) for name, c in keys.items()]
    if kind == "count_distinct":
        named.append(F.col(column).alias(ITEM))
    first = F.min(order_by) if order_by else F.max(F.lit(None).cast("int"))
    states = [c.alias(name) for name, c in _states(df, column, kind).items()]
    grouped = df.groupBy(*named).agg(*states, first.alias(FIRST))
    # Always true, and not foldable: it keeps every state in the plan, so that the
    # rankings and the final fold share one exchange instead of pruning it apart.
    alive = sum((F.isnull(s).cast("int") for s in (SUM, COUNT, LOW, HIGH, FIRST) if s in grouped.columns),
                F.col(ROWS))
    return grouped.filter(alive > 0)


def present(*keys: str, rows: str = ROWS) -> Column:
    """The keys are not null. Tied to a state, so the condition stays above the shared
    aggregation; pushed below it, each reader would scan the table for itself."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return F.when(F.col(rows) > 0, condition)


def rollup(groups: DataFrame, value: Column, *keys: str | Column) -> DataFrame:
    """``keys``, ``value``, ``rows`` and ``first`` per coarser group."""
    return groups.groupBy(*keys).agg(value.alias("value"), F.sum(ROWS).alias("rows"), F.min(FIRST).alias("first"))


def group_by_category(
    df: DataFrame, key: str, column: str | None, aggregation: str, order_by: str | None = None
) -> DataFrame:
    """``key``, ``value``, ``rows`` and ``first`` per non-null category."""
    label = category_key(F.col(key), df.schema[key].dataType)
    groups = partial_groups(df, {"key": label}, column, aggregation, order_by)
    kind = effective_aggregation(df, column, aggregation)
    return rollup(groups.filter(F.col("key").isNotNull()), finish(merged(kind), aggregation), "key")


# ---------- top-N with "Other" ----------


def ranked_names(
    groups: DataFrame, key: str, by: str, limits: dict[str, int], by_rows: bool = False
) -> DataFrame:
    """``(by, <key>_names)``: per chart the kept names in rank order, "Other" last if any fold.

    ``groups`` is a rollup with one row per chart and key; ``limits`` gives the
    number of names per chart. The rank filter runs before the shuffle, so a chart
    receives at most ``limit + 1`` rows per task however many keys there are.
    """
    measure = F.col("rows") if by_rows else F.col("value")
    order = [measure.desc(), F.col("first").asc_nulls_last(), F.col(key).asc()]
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    ranked = groups.filter(present(key, rows="rows")).withColumn("_rank", place).filter(F.col("_rank") <= max(limits.values()) + 1)
    entries = F.array_sort(F.collect_list(F.struct("_rank", F.col(key).alias("_name"))))
    listed = ranked.groupBy(by).agg(F.transform(entries, lambda s: s["_name"]).alias("_all"))
    limit = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col(by)]
    kept = F.filter(F.slice("_all", F.lit(1), limit - 1), lambda n: n != OTHER)
    names = F.when(F.size("_all") <= limit, F.col("_all")).otherwise(F.array_append(kept, F.lit(OTHER)))
    return listed.select(by, names.alias(f"{key}_names"))


def with_names(groups: DataFrame, names: DataFrame, key: str, by: str, charts: int) -> DataFrame:
    """Each row beside the names of its chart: a scalar for a single chart, else a
    lookup of one row of at most ``limit`` names per chart."""
    if charts == 1:
        return groups.withColumn(f"{key}_names", names.select(f"{key}_names").scalar())
    return groups.join(F.broadcast(names), by)


def folded(key: str) -> Column:
    """A key under its chart's names: itself when kept, else "Other"; null stays null."""
    c = F.col(key)
    return F.when(c.isNotNull(), F.when(F.array_contains(f"{key}_names", c), c).otherwise(F.lit(OTHER)))


def top_with_other(
    df: DataFrame,
    key: str,
    limit: int,
    column: str | None = None,
    aggregation: str = "count",
    by_rows: bool = False,
    order_by: str | None = None,
) -> DataFrame:
    """``key``, ``value``, ``rows``, ``ord``; the folded rows are re-aggregated, "Other" last."""
    label = category_key(F.col(key), df.schema[key].dataType)
    value = finish(merged(effective_aggregation(df, column, aggregation)), aggregation)
    groups = partial_groups(df, {"chart": F.lit("top"), "key": label}, column, aggregation, order_by)
    names = ranked_names(rollup(groups, value, "chart", "key"), "key", "chart", {"top": limit}, by_rows)
    kept = with_names(groups.filter(present("key")), names, "key", "chart", 1)
    place = (F.array_position("key_names", folded("key")) - 1).cast("int")
    cells = rollup(kept, value, folded("key").alias("key"), place.alias("ord"))
    return cells.select("key", "value", "rows", "ord")
