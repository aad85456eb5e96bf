"""Exact interpolated quantiles and distinct counts (P3, P4, E4) from one table of ordered value counts.

Values are counted where they are, meet by value, and are dealt to ranges of (column, value) once. A range's rows per
column are a sum of counts; prefix sums over the ranges tell which range holds a rank, and only there values are put in
order. No task holds more than its own range of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import is_number, is_temporal
from factloom.operators.counts import name_of, slots, whole_counts
from factloom.session import forget, stored


def orderable(dtype: T.DataType) -> bool:
    """Types whose values a double orders: numbers, days and timestamps."""
    return is_number(dtype) or is_temporal(dtype)


def _cell(name: str, dtype: T.DataType) -> Column:
    """A value as the long that tells it apart, or as a double."""
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.IntegralType):
        return c.cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long")
    if is_temporal(dtype):
        return F.unix_millis(c.cast("timestamp"))
    return c.cast("double")


class OrderedCounts:
    """The distinct values of some columns with their counts, in a stored table of ranges: ``name``, ``v``, ``k``, ``n``, ``part``.

    Doubles, integers, days and timestamps (to the millisecond) are told apart exactly; other numbers as doubles.
    """

    def __init__(self, df: DataFrame, columns: list[str]):
        self.columns = columns
        cells = df.select(*(_cell(c, df.schema[c].dataType) for c in columns))
        held = {t: F.col(v) for t, v in slots(cells).items()}
        k = held.get("bigint", F.lit(None).cast("long"))
        v = F.coalesce(held.get("double", F.lit(None)), k.cast("double"))
        counts = whole_counts(cells).select(name_of(columns).alias("name"), v.alias("v"), k.alias("k"), F.col("count").alias("n"))
        ranges = counts.repartitionByRange("name", "v").withColumn("part", F.spark_partition_id())
        self.table = stored(ranges, "ordered-counts")
        #: Rows and distinct values per column and range: as many rows as there are ranges and columns, at most.
        totals = self.table.groupBy("name", "part").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
        self.totals: dict[str, list[tuple[int, int, int]]] = {c: [] for c in columns}
        for r in sorted(totals.collect(), key=lambda r: r["part"]):
            self.totals[r["name"]].append((r["part"], r["n"], r["values"]))

    def distinct(self) -> dict[str, int]:
        """Exact distinct values per column."""
        return {c: sum(values for _, _, values in told) for c, told in self.totals.items()}

    def _place(self, column: str, rank: int) -> tuple[int, int]:
        """The range that holds a rank, and the rank inside it."""
        for part, n, _ in self.totals[column]:
            if rank < n:
                return part, rank
            rank -= n
        raise IndexError(rank)

    def quantiles(self, columns: list[str], fractions: tuple[float, ...]) -> dict[str, list[float | None]]:
        """Per column its quantiles, linear between neighbours; None without values."""
        wanted: dict[tuple[str, int], tuple[int, int, float]] = {}
        for c in columns:
            n = sum(rows for _, rows, _ in self.totals[c])
            for i, fraction in enumerate(fractions if n else ()):
                position = (n - 1) * fraction
                wanted[c, i] = int(position), min(int(position) + 1, n - 1), position - int(position)
        places = {(c, rank): self._place(c, rank) for (c, _), (lo, hi, _) in wanted.items() for rank in (lo, hi)}
        if not places:
            return {c: [None] * len(fractions) for c in columns}
        asked: dict[tuple[str, int], list[int]] = {}
        for (c, _), (part, rank) in places.items():
            asked.setdefault((c, part), []).append(rank)
        frame = self.table.sparkSession.createDataFrame([(c, part, ranks) for (c, part), ranks in asked.items()], "name string, part int, ranks array<bigint>")
        own = Window.partitionBy("name", "part").orderBy("v", "k")
        running = self.table.join(F.broadcast(frame), ["name", "part"]).withColumn("through", F.sum("n").over(own))
        held = running.select("name", "part", "v", "n", "through", F.explode("ranks").alias("rank")).filter("rank < through and rank >= through - n")
        found = {(r["name"], r["part"], r["rank"]): r["v"] for r in held.select("name", "part", "rank", "v").collect()}
        at = lambda c, rank: found[c, *places[c, rank]]
        out: dict[str, list[float | None]] = {c: [None] * len(fractions) for c in columns}
        for (c, i), (lo, hi, weight) in wanted.items():
            low, high = at(c, lo), at(c, hi)
            out[c][i] = low if low == high else low + (high - low) * weight
        return out

    def release(self) -> None:
        forget(self.table)


def quantiles(df: DataFrame, columns: list[str], fractions: tuple[float, ...]) -> DataFrame:
    """``(name, quantiles)`` per numeric column, linear between neighbours, nulls ignored."""
    found: dict[str, list[float | None]] = {}
    if columns:
        counts = OrderedCounts(df, columns)
        found = counts.quantiles(columns, fractions)
        counts.release()
    return df.sparkSession.createDataFrame(list(found.items()), "name string, quantiles array<double>")


def latency_percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row with ``p50``, ``p95`` and ``max``."""
    q = F.col("quantiles")
    found = quantiles(df, [column], (0.5, 0.95, 1.0))
    return found.select(q[0].alias("p50"), q[1].alias("p95"), q[2].alias("max"))
