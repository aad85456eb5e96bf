"""Sorting, paging and value lookup (Q6-Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import display_string
from factloom.model import PAGE_SIZES, Filters
from factloom.operators.filters import apply_filters
from factloom.session import forget, stored

VALUE_LIMIT = 100
CATALOG_PAGE = 50


def sort_rows(df: DataFrame, column: str, direction: str = "asc", order_by: list[str] | None = None) -> DataFrame:
    """Q6: nulls last both ways; ties follow ``order_by``, the columns giving row order."""
    c = F.col(column)
    first = c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last()
    return df.orderBy(first, *(order_by or []))


def _page(page: int | str, page_size: int | str) -> tuple[int, int]:
    """The offset of a page and its size; an odd page is the first, an odd size is 50."""
    number = max(1, int(page)) if str(page).isdigit() else 1
    size = int(page_size) if str(page_size).isdigit() and int(page_size) in PAGE_SIZES else 50
    return (number - 1) * size, size


def _sort_keys(df: DataFrame, sort: str, order_by: list[str] | None) -> list[Column]:
    column, _, direction = sort.partition(":")
    keys = [F.col(k) for k in order_by or []]
    if column in df.columns:
        c = F.col(column)
        keys = [c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last(), *keys]
    return keys or [F.col(f"`{c}`") for c in df.columns]


def rows_page(
    df: DataFrame,
    filters: Filters | None = None,
    sort: str = "",
    page: int | str = 1,
    page_size: int | str = 50,
    order_by: list[str] | None = None,
) -> DataFrame:
    """Q7: one page of the filtered, sorted rows with ``row_no`` and ``total``.

    Unknown sort columns are ignored, odd page sizes become 50. Without a sort column
    and ``order_by`` all columns give the order, so pages never overlap. Sort and
    offset compile to a distributed top-k, which suits the first pages; deep ones take
    a ``SeekIndex``. The total is a count of its own, which needs no column of the
    table. A page past the end has no row to carry the total; ``rows_total`` gives it
    for any page.
    """
    selected = apply_filters(df, filters)
    keys = _sort_keys(df, sort, order_by)
    start, size = _page(page, page_size)
    window = selected.orderBy(*keys).offset(start).limit(size)
    # A page holds at most 250 rows, so numbering it in one task is safe.
    row_no = F.row_number().over(Window.orderBy(*keys)) + start
    total = rows_total(df, filters).scalar()
    return window.select(*df.columns, row_no.alias("row_no"), total.alias("total"))


class SeekIndex:
    """Q7 at any depth: the filtered rows dealt once to ranges of their order, in a stored table with the rows of each range.

    Prefix sums over the ranges tell which of them hold a page; only those are read and put in order. Ranges are as even
    as their sampled bounds; rows that no key tells apart share one, so ``order_by`` should end with a key of the table.
    """

    def __init__(self, df: DataFrame, filters: Filters | None = None, sort: str = "", order_by: list[str] | None = None, ranges: int | None = None):
        self.columns, self.keys = df.columns, _sort_keys(df, sort, order_by)
        selected = apply_filters(df, filters)
        dealt = selected.repartitionByRange(ranges, *self.keys) if ranges else selected.repartitionByRange(*self.keys)
        self.table = stored(dealt.withColumn("_range", F.spark_partition_id()), "sorted-rows")
        counts = self.table.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per range
        self.sizes = sorted((r["_range"], r["n"]) for r in counts)
        self.total = sum(n for _, n in self.sizes)

    def page(self, page: int | str = 1, page_size: int | str = 50) -> DataFrame:
        """The rows of ``rows_page``. A page past the end has none; ``total`` is here, too."""
        start, size = _page(page, page_size)
        bases, before = {}, 0
        for k, n in self.sizes:
            if before < start + size and before + n > start:
                bases[k] = before
            before += n
        held = self.table.filter(F.col("_range").isin(list(bases)))
        base = F.create_map(*(F.lit(x) for pair in bases.items() for x in pair))[F.col("_range")] if bases else F.lit(0)
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*self.keys)) + base
        rows = held.select(*self.columns, place.cast("int" if self.total < 2**31 else "long").alias("row_no"), F.lit(self.total).cast("long").alias("total"))
        return rows.filter(F.col("row_no").between(start + 1, start + size))

    def release(self) -> None:
        forget(self.table)


def rows_total(df: DataFrame, filters: Filters | None = None) -> DataFrame:
    """Q7: the ``total`` that every page of the filtered rows belongs to, also one past the end."""
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("total"))


def filter_values(df: DataFrame, column: str, q: str = "", limit: int = VALUE_LIMIT) -> DataFrame:
    """Q8: distinct display values with counts, most frequent first; ``q`` is a literal."""
    values = df.select(display_string(F.col(column), df.schema[column].dataType).alias("value"))
    values = values.filter(F.col("value").isNotNull())
    if q:
        values = values.filter(F.lower("value").contains(q.lower()))
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("value")).limit(limit)


def catalog_page(
    df: DataFrame,
    q: str = "",
    search: list[str] | None = None,
    sort: str = "newest",
    cursor: int | str | None = None,
    size: int = CATALOG_PAGE,
    name: str = "name",
    created: str = "created_at",
    rows: str = "row_count",
) -> DataFrame:
    """Q9: a page of a catalog with ``next_cursor``, null on the last page."""
    offset = int(cursor) if cursor is not None and str(cursor).isdigit() else 0
    needle = q.strip().lower()
    found = df
    if needle:
        condition = F.lit(False)
        for column in search or [name]:
            condition = condition | F.lower(column).contains(needle)
        found = found.filter(condition)
    keys = {
        "name": [F.lower(name).asc(), F.col(name).asc()],
        "rows": [F.col(rows).desc_nulls_last(), F.col(created).desc()],
    }.get(sort, [F.col(created).desc()])
    window = found.orderBy(*keys).offset(offset).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*keys))
    numbered = window.withColumn("_place", place).withColumn(
        "next_cursor",
        F.when(F.max("_place").over(Window.partitionBy()) > size, F.lit(str(offset + size))),
    )
    return numbered.filter(F.col("_place") <= size).drop("_place")


def latest_by(df: DataFrame, key: list[str], ts: str, tie: list[str] | None = None) -> DataFrame:
    """Q10: the most recent row per key, as an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    order = F.struct(*(F.col(c) for c in [ts, *(tie or [])]))
    latest = F.max_by(F.struct(*(F.col(c) for c in rest)), order)
    return df.groupBy(*key).agg(latest.alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)
