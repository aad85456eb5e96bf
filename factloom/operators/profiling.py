"""Column profiles (P1-P8): one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.calendar import infer_grain
from factloom.functions.rounding import js_round, mean
from factloom.functions.text import display_string, is_number, is_temporal, iso_string
from factloom.operators.counts import name_of, slots, whole_counts
from factloom.operators.quantiles import OrderedCounts, orderable

TOP_VALUES = 10
NUMERIC = "struct<min:double,max:double,mean:double,median:double,p95:double,sum:double>"
DATETIME = "struct<min:string,max:string,grain:string>"
TOP = "array<struct<value:string,count:bigint>>"


def identity(c: Column, dtype: T.DataType, shown: bool) -> Column:
    """What tells values apart: a long or a double where it does so exactly as the display text, else that text.

    Only integers keep their text when they are ``shown`` from it later.
    """
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    if not shown and isinstance(dtype, T.DoubleType):
        return c
    if not shown and isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if not shown and is_temporal(dtype):
        return F.unix_millis(c.cast("timestamp"))
    return display_string(c, dtype)


def value_counts(df: DataFrame, names: list[str], shown: bool = True) -> DataFrame:
    """``(name, value, count)`` of several columns, in a shuffle per column.

    Counts are combined before the shuffle, so a value that fills a third of the
    table arrives as one row per task. Values become texts after they are counted.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "name string, value string, count long")
    cells = df.select(*(identity(F.col(f"`{n}`"), df.schema[n].dataType, shown) for n in names))
    value = F.coalesce(*(F.col(v).cast("string") for v in slots(cells).values()))
    return whole_counts(cells).select(name_of(names).alias("name"), value.alias("value"), "count")


def distinct_counts(counts: DataFrame) -> DataFrame:
    """Exact distinct values per column."""
    # count_if keeps ``count`` in the plan: same exchange as the top values.
    return counts.groupBy("name").agg(F.count_if(F.col("count") > 0).alias("distinct_count"))


def top_values(counts: DataFrame, limit: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column; the rank filter runs before the shuffle."""
    order = Window.partitionBy("name").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    return ranked.groupBy("name").agg(
        F.transform(listed, lambda t: F.struct(t["value"].alias("value"), t["count"].alias("count"))).alias("top")
    )


def _null_share(name: str) -> Column:
    """4 places; 0 for an empty table."""
    return js_round(F.coalesce(F.avg(F.col(f"`{name}`").isNull().cast("double")), F.lit(0.0)), 4)


def _numeric(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.struct(
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        js_round(mean(F.sum(c), F.count(c)), 4).alias("mean"),
        js_round(F.sum(c), 2).alias("sum"),
    )


def _datetime(df: DataFrame, name: str) -> Column:
    """P5: ISO bounds and the grain."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    lo, hi = iso_string(F.min(c), dtype), iso_string(F.max(c), dtype)
    at_start = F.bool_and(c.cast("timestamp") == F.date_trunc("month", c))
    monthly = at_start & (F.count(c) > 1) & (lo != hi)
    return F.struct(lo.alias("min"), hi.alias("max"), infer_grain(lo, hi, monthly).alias("grain"))


def profile_table(
    df: DataFrame,
    types: dict[str, str],
    dataset_id: str | None = None,
) -> DataFrame:
    """Profiles of a typed table in column order.

    ``types`` gives the semantic types. One wide aggregate covers null shares,
    moments and date bounds; value counts cover distinct counts and top values of
    columns whose values are listed; ordered counts cover distinct counts and
    quantiles of numbers and dates.
    """
    names = [n for n in df.columns if n in types]
    kinds = {n: df.schema[n].dataType for n in names}
    numeric = [n for n in names if types[n] == "numeric" and is_number(kinds[n])]
    dated = [n for n in names if types[n] == "datetime" and is_temporal(kinds[n])]
    entries = []
    for position, n in enumerate(names):
        entries.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(n).alias("name"),
                F.lit(types[n]).alias("type"),
                _null_share(n).alias("null_pct"),
                (F.count(F.col(f"`{n}`")) > 0).alias("filled"),
                (_numeric(n) if n in numeric else F.lit(None)).cast("struct<min:double,max:double,mean:double,sum:double>").alias("moments"),
                (_datetime(df, n) if n in dated else F.lit(None)).cast(DATETIME).alias("datetime"),
            )
        )
    basics = df.agg(F.array(*entries).alias("columns")).select(F.inline("columns"))
    # Numbers and dates are counted, but never listed. Decimals and floats are told apart by their texts.
    silent = numeric + dated
    ordered = [n for n in silent if orderable(kinds[n])]
    by_text = [n for n in numeric if not isinstance(kinds[n], (T.IntegralType, T.DoubleType))]
    counts = value_counts(df, [n for n in names if n not in silent])
    distinct = distinct_counts(counts)
    if by_text:
        distinct = distinct.unionByName(distinct_counts(value_counts(df, by_text, shown=False)))
    spread = df.sparkSession.createDataFrame([], "name string, quantiles array<double>")
    if ordered:
        told = OrderedCounts(df, ordered)
        known = [(n, d) for n, d in told.distinct().items() if n not in by_text]
        distinct = distinct.unionByName(df.sparkSession.createDataFrame(known, "name string, distinct_count long"))
        spread = df.sparkSession.createDataFrame(list(told.quantiles(numeric, (0.5, 0.95)).items()), spread.schema)
        told.release()
    joined = (
        basics.join(distinct, "name", "left")
        .join(top_values(counts), "name", "left")
        .join(spread, "name", "left")
    )
    m, q = F.col("moments"), F.col("quantiles")
    stats = F.struct(
        m["min"].alias("min"), m["max"].alias("max"), m["mean"].alias("mean"),
        js_round(q[0], 4).alias("median"), js_round(q[1], 4).alias("p95"), m["sum"].alias("sum"),
    )
    ranked = ~F.col("name").isin(silent) if silent else F.lit(True)
    return joined.select(
        F.lit(dataset_id or "").alias("dataset_id"),
        "name",
        "position",
        "type",
        "null_pct",
        F.coalesce("distinct_count", F.lit(0).cast("bigint")).alias("distinct_count"),
        F.when(m.isNotNull() & F.col("filled"), stats).cast(NUMERIC).alias("numeric"),
        F.when(F.col("filled"), F.col("datetime")).alias("datetime"),
        F.when(ranked, F.coalesce("top", F.array().cast(TOP))).cast(TOP).alias("top"),
    )


def table_size(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))
