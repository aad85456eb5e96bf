"""Type inference and coercion (T1-T4) over all-string tables; inference reads the texts of other types too."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.text import WHITE_SPACE, boolean_of, datetime_of, number_of, trimmed
from factloom.operators.counts import name_of, whole_counts
from factloom.session import pin

# Names that decide a type, and the shape of an id.
ID_NAME = r"(?i)(^id$|_id$|^id_|uuid|guid)"
CODE_NAME = r"(?i)(status|code|level|rating|tier)"
ID_VALUE = r"^[A-Za-z]*[-_]?[0-9]+$"

DATE_SHARE, NUMBER_SHARE = 0.9, 0.95
CODE_VALUES, CATEGORY_FLOOR, CATEGORY_CEILING, CATEGORY_SHARE = 12, 50, 200, 0.05
INTEGER_LIMIT = float(2**53)


@dataclass(frozen=True)
class ColumnPlan:
    """What one column becomes: its semantic type and the two whole-column choices."""

    name: str
    position: int
    type: str
    integers: bool = False
    days: bool = False


TYPED = ("tinyint", "smallint", "int", "bigint", "double", "date", "timestamp", "timestamp_ntz")  # told apart as their texts are
LISTED = CATEGORY_CEILING + 1  # texts of a column that a task tells: no rule asks for more


def _values(df: DataFrame) -> DataFrame:
    """``(name, raw, n, listed)``: what each Arrow batch holds of a column, each text once.

    A column of few values so costs a few rows a batch, however often they occur. ``listed`` marks the first ``LISTED``
    non-blank texts that a task meets in a column: the bounded sets whose union counts distinct texts as far as rules ask.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set[str]] = [set() for _ in names]
        for batch in batches:
            for name, column, met in zip(names, batch.columns, seen):
                found = pc.value_counts(column.drop_null())
                raw = found.field("values")
                listed = np.zeros(len(raw), bool)
                if len(met) < LISTED:
                    for k, text in enumerate(raw.to_pylist()):
                        if len(met) < LISTED and text not in met and text.strip(WHITE_SPACE):
                            met.add(text)
                            listed[k] = True
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(raw), pa.string()), raw, found.field("counts"), pa.array(listed)], names=["name", "raw", "n", "listed"])

    cells = df.select(*(F.col(f"`{n}`").cast("string") for n in names))
    return cells.mapInArrow(run, "name string, raw string, n long, listed boolean")


def _typed_values(df: DataFrame) -> DataFrame:
    """``(name, raw, n, alone)`` of columns that are no texts: a value becomes one after it is counted in the whole table.

    ``alone`` is the number of texts that a row stands for: two for a zero that is met with both signs. Timestamps are
    counted as microseconds, which is far faster.
    """
    pin(df.sparkSession)
    cells, texts = [], []
    for place, (name, kind) in enumerate(df.dtypes):
        c, stamp = F.col(f"`{name}`"), kind.startswith("timestamp")
        cells.append(F.unix_micros(c.cast("timestamp")) if stamp else c)
        texts.append((F.timestamp_micros("v_bigint").cast(kind) if stamp else F.col(f"v_{kind}")).cast("string"))
    counts = whole_counts(df.select(*cells))
    raw = F.coalesce(*(F.when(F.col("place") == i, t) for i, t in enumerate(texts)))
    alone = F.when((F.col("minus") > 0) & (F.col("minus") < F.col("count")), 2).otherwise(1).cast("long")
    return counts.select(name_of(df.columns).alias("name"), raw.alias("raw"), F.col("count").alias("n"), alone.alias("alone"))


def _all_values(df: DataFrame) -> DataFrame:
    """``(name, raw, n, listed, alone)`` of all columns: ``alone`` is null for those of texts, ``listed`` for the others."""
    typed = [n for n, t in df.dtypes if t in TYPED]
    texts = df.select(*(F.col(f"`{n}`") for n in df.columns if n not in typed))
    if not typed:
        return _values(texts).withColumn("alone", F.lit(None).cast("long"))
    values = _typed_values(df.select(*(F.col(f"`{n}`") for n in typed)))
    return values.unionByName(_values(texts), allowMissingColumns=True) if texts.columns else values.withColumn("listed", F.lit(False))


def _statistics(df: DataFrame) -> DataFrame:
    """One row per column with at least one row, from a single scan of texts. ``distinct`` is exact below ``LISTED``;
    ``repeated`` tells that some text was met twice, but not every repetition is."""
    text, n = F.col("text"), F.col("n")
    # Only texts may be blank; a filter on the text of a counted value would be asked of every cell.
    cells = _all_values(df).withColumn("text", trimmed(F.col("raw"))).filter(F.col("alone").isNotNull() | (text != ""))
    parsed = cells.select(
        "name",
        F.when(F.col("listed"), F.col("raw")).alias("key"),
        "n",
        "alone",
        number_of(text).alias("number"),
        datetime_of(text).isNotNull().alias("dated"),
        (F.length(text) <= 10).alias("day"),  # of the accepted forms, the plain dates
        boolean_of(text).isNotNull().alias("flag"),
        F.col("raw").rlike(ID_VALUE).alias("id_like"),
    )
    of = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0).cast("long"))
    sums = {
        "present": F.sum("n"),
        "flags": of(F.col("flag")),
        "dates": of(F.col("dated")),
        "timed": of(F.col("dated") & ~F.col("day")),
        "numbers": of(F.col("number").isNotNull()),
        "integers": of(F.col("number") == F.floor("number")),
        "id_like": of(F.col("id_like")),
    }
    # Rows of listed texts meet by text, all others of a column as one row a task.
    listed = parsed.groupBy("name", "key").agg(*(c.alias(a) for a, c in sums.items()), F.max(F.abs("number")).alias("largest"), F.max("n").alias("most"), F.sum("alone").alias("alone"))
    most = F.greatest(F.col("most"), F.when(F.col("key").isNotNull(), F.col("present")))
    return listed.groupBy("name").agg(
        *(F.sum(a).alias(a) for a in sums), F.max("largest").alias("largest"), (F.count("key") + F.coalesce(F.sum("alone"), F.lit(0))).alias("distinct"), F.max(most > 1).alias("repeated")
    )


def _with_repeats(df: DataFrame, names: list[str]) -> set[str]:
    """The columns among a few in which a non-blank text occurs twice: exact, in one shuffle of their texts."""
    cells = df.select(*(F.col(f"`{n}`").cast("string").alias(n) for n in names)).unpivot([], [F.col(f"`{n}`") for n in names], "name", "raw")
    twice = cells.filter(trimmed(F.col("raw")) != "").groupBy("name", "raw").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return {r["name"] for r in twice.select("name").distinct().collect()}


def type_rules(unique: Column) -> Column:
    """The first matching rule over a column's statistics."""
    n, name, distinct = F.col("present"), F.col("name"), F.col("distinct")
    numeric = F.col("numbers") >= NUMBER_SHARE * n
    code = (F.col("integers") == n) & (distinct <= CODE_VALUES) & name.rlike(CODE_NAME)
    few = F.least(F.lit(float(CATEGORY_CEILING)), F.greatest(F.lit(float(CATEGORY_FLOOR)), n * CATEGORY_SHARE))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("text"))
        .when(name.rlike(ID_NAME), F.lit("id"))
        .when(F.col("flags") == n, F.lit("boolean"))
        .when(F.col("dates") >= DATE_SHARE * n, F.lit("datetime"))
        .when(numeric & code, F.lit("categorical"))
        .when(numeric, F.lit("numeric"))
        .when(distinct <= few, F.lit("categorical"))
        .when(unique & (F.col("id_like") == n), F.lit("id"))
        .otherwise(F.lit("text"))
    )


def plan_columns(df: DataFrame) -> list[ColumnPlan]:
    """T1 and the whole-column decisions of T2: one scan. Only columns that are ids if no text repeats, and in which no
    repetition was met, are read once more."""
    told = _statistics(df).select("*", type_rules(~F.col("repeated")).alias("type"), type_rules(F.lit(False)).alias("repeating"))
    rows = {r["name"]: r.asDict() for r in told.collect()}
    unsure = [name for name, r in rows.items() if r["type"] != r["repeating"]]
    repeats = _with_repeats(df, unsure) if unsure else set()
    kind = lambda name: rows[name]["repeating" if name in repeats else "type"] if name in rows else "text"
    return [column_choices(name, i, kind(name), rows.get(name)) for i, name in enumerate(df.columns)]


def column_choices(name: str, position: int, kind: str, row: dict | None) -> ColumnPlan:
    """Long or double, date or timestamp: decided by every parsed value of the column."""
    row = row or {"numbers": 0, "integers": 0, "largest": None, "timed": 0}
    integers = row["numbers"] > 0 and row["integers"] == row["numbers"] and row["largest"] < INTEGER_LIMIT
    return ColumnPlan(name, position, kind, integers=integers, days=row["timed"] == 0)


def type_frame(df: DataFrame, plans: list[ColumnPlan]) -> DataFrame:
    """``(name, position, type)`` as a table."""
    rows = [(p.name, p.position, p.type) for p in plans]
    return df.sparkSession.createDataFrame(rows, "name string, position int, type string")


def infer_types(df: DataFrame) -> DataFrame:
    """One row per column of an all-string table."""
    return type_frame(df, plan_columns(df))


def coerced(plan: ColumnPlan) -> Column:
    """One trimmed column in its type; unparseable values become null."""
    text = F.col(f"`{plan.name}`")
    if plan.type == "numeric":
        value = number_of(text).try_cast("bigint") if plan.integers else number_of(text)
    elif plan.type == "datetime":
        stamp = datetime_of(text)
        value = stamp.cast("date") if plan.days else stamp
    elif plan.type == "boolean":
        value = boolean_of(text)
    else:
        value = F.nullif(text, F.lit(""))
    return value.alias(plan.name, metadata={"type": plan.type})


def plans_for(df: DataFrame, types: dict[str, str]) -> list[ColumnPlan]:
    """Whole-column decisions for given types, from one scan."""
    rows = {r["name"]: r.asDict() for r in _statistics(df.select(*types)).collect()}
    return [column_choices(n, i, types[n], rows.get(n)) for i, n in enumerate(df.columns) if n in types]


def coerce(df: DataFrame, types: dict[str, str] | list[ColumnPlan]) -> DataFrame:
    """The typed table. Column plans of T1 save the scan for the decisions."""
    plans = plans_for(df, types) if isinstance(types, dict) else types
    text = df.select(*(trimmed(F.col(f"`{p.name}`")).alias(p.name) for p in plans))
    return text.select(*(coerced(p) for p in plans))


def retype(plans: list[ColumnPlan], df: DataFrame, column: str, kind: str) -> list[ColumnPlan]:
    """The plans with one column's type replaced, decided again from the raw strings."""
    fresh = plans_for(df.select(column), {column: kind})[0]
    return [ColumnPlan(column, p.position, kind, fresh.integers, fresh.days) if p.name == column else p for p in plans]


def date_column(types: DataFrame) -> DataFrame:
    """T4: the first datetime column by position; per dataset when the table has them."""
    keys = ["dataset_id"] if "dataset_id" in types.columns else []
    return (
        types.filter(F.col("type") == "datetime").groupBy(*keys).agg(F.min_by("name", "position").alias("date_column"))
    )


def effective_types(columns: DataFrame) -> DataFrame:
    """Override types where set, inferred types elsewhere."""
    return columns.withColumn("type", F.coalesce("override_type", "inferred_type"))


def first_by_position(columns: DataFrame, condition: Column, key: str = "dataset_id") -> DataFrame:
    """The first column per dataset that meets a condition."""
    ranked = columns.filter(condition).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(key).orderBy("position"))
    )
    return ranked.filter("_rank = 1").drop("_rank")
