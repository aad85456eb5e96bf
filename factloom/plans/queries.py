"""One query per operator over the driver's tables.

Every query reads whole tables. Row order, where an operator needs one, is the
table's key column. Each has a twin in ``oracles``, unless SQL cannot express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import functions as fn
from factloom.model import DateRange, Filters, WhereIn, WidgetSpec
from factloom.operators import (
    aggregates,
    anomalies,
    brief,
    changes,
    charts,
    cube,
    dashboards,
    filters,
    grounding,
    inference,
    jobs,
    kpis,
    limiter,
    measures,
    paging,
    profiling,
    quantiles,
)
from factloom.plans.dashboard import dashboard_query
from factloom.session import handful, pin
from factloom.sources.tables import rows_json

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# ---------- values ----------


@query
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        fn.js_round(c, 0).alias("whole"),
        fn.js_round(-c / 8, 1).alias("tenth"),
        fn.js_round(c / 3, 4).alias("fourth"),
    )


@query
def bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    parts = []
    for grain in ("hour", "day", "week", "month"):
        counts = events.groupBy(fn.bucket_start(F.col("ts"), grain).alias("start")).agg(F.count(F.lit(1)).alias("n"))
        key = fn.bucket_text(F.col("start"), grain)
        parts.append(
            counts.select(F.lit(grain).alias("grain"), key.alias("key"), fn.period_label(key, grain).alias("label"),
                          fn.in_period(key, grain).alias("phrase"), fn.bucket_key(key, "month").alias("month_key"), "n")
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    iso = fn.iso_string(F.col("ts"), events.schema["ts"].dataType)
    return events.groupBy("user_id").agg(
        F.min(fn.day_index(F.col("ts"))).alias("first_day"),
        F.max(fn.day_index(F.col("ts"))).alias("last_day"),
        F.max(fn.epoch_seconds(iso)).alias("last_second"),
        F.max(iso).alias("last_text"),
    )


@query
def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    shown = [fn.display_string(F.col(c), lines.schema[c].dataType).alias(c) for c in ("l_quantity", "l_discount", "l_shipdate")]
    return lines.groupBy(*shown).agg(F.count(F.lit(1)).alias("n"))


@query
def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large and small doubles: exponent-free texts."""
    lines = table(spark, sf_dir, "lineitem")
    big, small = F.col("l_extendedprice") * 1000 + 0.5, F.col("l_discount") / 100
    double = lines.schema["l_tax"].dataType
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", fn.display_string(big, double).alias("big"),
                        fn.display_string(F.round(small, 6), double).alias("small"))


@query
def category_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    dear = F.when(F.col("event_type") != "error", F.col("value") > 50)
    boolean = events.select(dear.alias("b")).schema["b"].dataType
    return events.groupBy(fn.category_key(dear, boolean).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _raw_orders(orders: DataFrame) -> DataFrame:
    """Orders as a user would have typed them."""
    day = F.col("o_orderdate")
    slash = F.concat_ws("/", F.month(day), F.dayofmonth(day), F.year(day))
    word = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "NO ").otherwise("maybe")
    return orders.select(
        "o_orderkey",
        F.concat(F.lit(" $"), F.col("o_totalprice").cast("string")).alias("price"),
        F.concat((F.col("o_orderkey") % 50).cast("string"), F.lit("%")).alias("share"),
        word.alias("flag"),
        slash.alias("day"),
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:30:05.25+02:00")).alias("stamp"),
        F.concat(F.lit("\t"), "o_orderpriority", F.lit("  ")).alias("note"),
    )


@query
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_orders(table(spark, sf_dir, "orders"))
    return raw.select(
        "o_orderkey",
        fn.to_number(F.col("price")).alias("price"),
        fn.to_number(F.col("share")).alias("share"),
        fn.to_number(F.col("flag")).alias("no_number"),
        fn.to_boolean(F.col("flag")).cast("int").alias("flag"),
        fn.is_day_only(F.col("day")).cast("int").alias("day_only"),
        F.date_format(fn.to_datetime(F.col("day")), "yyyy-MM-dd").alias("day"),
        F.date_format(fn.to_datetime(F.col("stamp")), "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"),
        fn.stripped(F.col("note")).alias("note"),
    )


# ---------- types ----------

INFERRED = ("orders", "events", "customer", "lineitem", "part", "supplier", "nation", "labels")


def as_strings(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


@query
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in INFERRED:
        types = inference.infer_types(as_strings(table(spark, sf_dir, name))).withColumn("dataset_id", F.lit(name))
        found = types if found is None else found.unionByName(types)
    return found


@query
def date_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.date_column(infer_types(spark, sf_dir))


@query
def coerce_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_orders(table(spark, sf_dir, "orders")).withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    typed = inference.coerce(raw, inference.plan_columns(raw))
    # Dates keep days only, the price stays double, the key and the share become integers.
    return typed.select("o_orderkey", "price", "share", "flag", F.col("day").cast("string").alias("day"),
                        F.date_format("stamp", "yyyy-MM-dd HH:mm:ss.SSS").alias("stamp"), "note")


@query
def retyped_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column read again as another type from the same strings."""
    raw = as_strings(table(spark, sf_dir, "part"))
    plans = inference.retype(inference.plan_columns(raw), raw, "p_size", "categorical")
    return inference.coerce(raw, plans).groupBy("p_size").agg(F.count(F.lit(1)).alias("n"), F.max("p_retailprice").alias("dearest"))


# ---------- profiles ----------


@query
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    lines = table(spark, sf_dir, "lineitem").select(*names)
    profile = profiling.profile_table(lines, {n: "numeric" for n in names})
    return profile.select("name", "position", "null_pct", "distinct_count", "numeric.*")


@query
def profile_numeric_bracketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles alone, from the ordered counts of two columns."""
    lines = table(spark, sf_dir, "lineitem")
    found = quantiles.quantiles(lines, ["l_extendedprice", "l_quantity"], (0.5, 0.95))
    q = F.col("quantiles")
    return found.select("name", fn.js_round(q[0], 4).alias("median"), fn.js_round(q[1], 4).alias("p95"))


@query
def profile_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):
        profile = profiling.profile_table(table(spark, sf_dir, name).select(c), {c: "datetime"}, name)
        found = profile if found is None else found.unionByName(profile)
    return found.select("dataset_id", "name", "null_pct", "distinct_count", "datetime.*")


@query
def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("p_name", "p_brand", "p_type")
    profile = profiling.profile_table(table(spark, sf_dir, "part").select(*names), {n: "categorical" for n in names})
    return profile.select("name", "distinct_count", F.posexplode("top").alias("rank", "t")).select(
        "name", "distinct_count", "rank", F.col("t.value").alias("value"), F.col("t.count").alias("n")
    )


@query
def table_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for name in INFERRED:
        size = profiling.table_size(table(spark, sf_dir, name)).withColumn("dataset_id", F.lit(name))
        found = size if found is None else found.unionByName(size)
    return found


# ---------- filters, paging, lookup ----------

STATUS = WhereIn("o_orderstatus", ("F", "O"))
TWO_YEARS = DateRange("o_orderdate", "1996-01-01", "1997-12-31")


@query
def filters_date_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return filters.apply_filters(orders, Filters(TWO_YEARS, (STATUS,))).select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


@query
def filters_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where-in on display texts of numbers: what is no number's text never matches."""
    lines = table(spark, sf_dir, "lineitem")
    wanted = Filters(None, (WhereIn("l_linenumber", ("1", "02", "x", "3")), WhereIn("l_discount", ("0.05", "0.1", "0.10"))))
    return filters.apply_filters(lines, wanted).groupBy("l_linenumber", "l_discount").agg(F.count(F.lit(1)).alias("n"))


@query
def filters_by_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where-in on the texts of timestamps, those of the first event of each type, beside texts that are none."""
    events = table(spark, sf_dir, "events")
    firsts = events.groupBy("event_type").agg(fn.iso_string(F.min("ts"), events.schema["ts"].dataType).alias("at")).collect()  # a row per type
    wanted = (*(r["at"] for r in firsts), "2024-01-01", "2024-02-30T00:00:00.000Z", "soon")
    kept = filters.apply_filters(events, Filters(None, (WhereIn("ts", wanted),)))
    return kept.select("event_id", "event_type")


def _preset(spark: SparkSession, sf_dir: str, preset: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kept = filters.apply_filters(events, Filters(filters.resolve_date_range(events, "ts", preset)))
    return kept.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"),
    )


@query
def date_preset_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preset(spark, sf_dir, "7d")


@query
def date_preset_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preset(spark, sf_dir, "30d")


@query
def date_preset_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preset(spark, sf_dir, "ytd")


@query
def rows_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    page = paging.rows_page(orders, Filters(None, (STATUS,)), "o_totalprice:desc", 3, 50, ["o_orderkey"])
    return page


@query
def deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last full page of all lines: one range of the order is read and sorted."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    index = paging.SeekIndex(lines, None, "l_extendedprice:desc", ["l_orderkey", "l_linenumber", "l_partkey"])
    return index.page(index.total // 50, 50)


@query
def rows_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_json(table(spark, sf_dir, "orders"))


@query
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paging.filter_values(table(spark, sf_dir, "part"), "p_name", "RE")
    return found.withColumnRenamed("count", "n")


@query
def filter_values_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.filter_values(table(spark, sf_dir, "lineitem"), "l_quantity").withColumnRenamed("count", "n")


@query
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return paging.catalog_page(customers, "MACH", ["c_name", "c_mktsegment"], "rows", 50, 50, "c_name", "c_custkey", "c_acctbal")


@query
def catalog_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "supplier")
    return paging.catalog_page(parts, "", None, "name", None, 50, "s_name", "s_suppkey", "s_acctbal")


@query
def latest_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.latest_by(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


@query
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = paging.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


# ---------- aggregation ----------


@query
def aggregates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("dear", F.col("value") > 50)
    cases = [("value", a) for a in ("sum", "avg", "count", "min", "max", "count_distinct")]
    cases += [("event_type", "count_distinct"), ("event_type", "sum"), ("dear", "avg"), ("dear", "sum"), ("gone", "avg")]
    values = [fn.finish(aggregates.aggregate_column(events, c, a), a).alias(f"{c}_{a}") for c, a in cases]
    return events.agg(*values)


@query
def masked_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    masks = {"open": F.col("l_linestatus") == "O", "back": F.col("l_returnflag") == "R", "both": (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")}
    cases = [("l_extendedprice", "sum"), ("l_quantity", "avg"), ("l_partkey", "count_distinct"), (None, "count"), ("l_discount", "max")]
    values = [
        fn.finish(aggregates.aggregate_column(lines, c, a, m), a).alias(f"{name}_{a}") for name, m in masks.items() for c, a in cases
    ]
    return lines.agg(*values)


@query
def group_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return aggregates.group_by_category(lines, "l_linenumber", "l_extendedprice", "avg", "l_orderkey")


@query
def category_top_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return charts.category_series(parts, WidgetSpec("bar", "p_brand", "sum", "p_retailprice", limit=5), "p_partkey")


@query
def category_distinct_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return aggregates.top_with_other(events, "event_type", 3, "user_id", "count_distinct", order_by="event_id")


@query
def category_rows_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return aggregates.top_with_other(parts, "p_name", 6, "p_retailprice", "avg", by_rows=True, order_by="p_partkey")


@query
def category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return charts.category_series(lines, WidgetSpec("bar", "l_returnflag", "count", split="l_linestatus"), "l_orderkey")


@query
def category_split_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    spec = WidgetSpec("donut", "l_linenumber", "avg", "l_quantity", split="l_tax")
    return charts.category_series(lines, spec, "l_orderkey")


@query
def time_series_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly average order value by priority, two statuses, four years."""
    orders = table(spark, sf_dir, "orders")
    kept = filters.apply_filters(orders, Filters(DateRange("o_orderdate", "1996-01-01", "1999-12-31"), (STATUS,)))
    spec = WidgetSpec("line", "o_orderdate", "avg", "o_totalprice", split="o_orderpriority", time_grain="month")
    return charts.time_series(kept, spec, "o_orderkey")


@query
def time_series_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    spec = WidgetSpec("area", "l_shipdate", "sum", "l_extendedprice", split="l_linenumber", time_grain="month")
    return charts.time_series(lines, spec, "l_orderkey")


@query
def time_series_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return charts.time_series(events, WidgetSpec("line", "ts", "count", split="event_type", time_grain="hour"), "event_id")


@query
def time_series_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average has no zero: series without rows in a bucket stay away."""
    events = table(spark, sf_dir, "events").withColumn("who", F.col("user_id") % 7)
    return charts.time_series(events, WidgetSpec("line", "ts", "max", "value", split="who", time_grain="hour"), "event_id")


@query
def time_series_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return charts.time_series(lines, WidgetSpec("line", "l_shipdate", "sum", "l_extendedprice", time_grain="week"))


@query
def time_series_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    spec = WidgetSpec("line", "ts", "count_distinct", "user_id", split="event_type", time_grain="day")
    return charts.time_series(events, spec, "event_id")


@query
def histogram_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.histogram(table(spark, sf_dir, "orders"), "o_totalprice")


@query
def histogram_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.histogram(table(spark, sf_dir, "lineitem"), "l_linenumber")


ORDER_WIDGETS = {
    "line": WidgetSpec("line", "o_orderdate", "avg", "o_totalprice", time_grain="month"),
    "rows": WidgetSpec("area", "o_orderdate", "count", time_grain="month"),
    "status": WidgetSpec("bar", "o_orderstatus", "avg", "o_totalprice", limit=8),
    "priority": WidgetSpec("bar", "o_orderpriority", "sum", "o_totalprice", limit=4),
    "buyers": WidgetSpec("donut", "o_orderpriority", "count_distinct", "o_custkey", limit=6),
    "spread": WidgetSpec("histogram", "o_totalprice"),
}
ORDER_KPIS = [
    kpis.Kpi("entities", "Customers", "o_custkey", "count_distinct", "number"),
    kpis.Kpi("m:o_totalprice", "Average o totalprice", "o_totalprice", "avg", "currency"),
]


@query
def dashboard_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wanted = Filters(DateRange("o_orderdate", "1996-01-01", "1999-12-31"), (STATUS,))
    return dashboard_query(orders, ORDER_WIDGETS, wanted, date_column="o_orderdate", order_by="o_orderkey").points


@query
def dashboard_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    wanted = Filters(DateRange("o_orderdate", "1997-01-01", "1997-12-31"), (STATUS,))
    result = dashboard_query(orders, {}, wanted, ORDER_KPIS, "o_orderdate")
    return result.kpis


# ---------- KPIs ----------

EVENT_KPIS = [
    kpis.Kpi("entities", "Users", "user_id", "count_distinct", "number"),
    kpis.Kpi("m:value", "Total value", "value", "sum", "number"),
    kpis.Kpi("rate:is_error", "Error rate", "is_error", "avg", "percent", 100.0),
]


def flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("is_error", F.col("event_type") == "error")


@query
def kpis_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.compute_kpis(flagged_events(spark, sf_dir), EVENT_KPIS, "ts")


@query
def kpis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = Filters(DateRange("ts", "2024-01-15", "2024-01-21"), (WhereIn("event_type", ("click", "error", "view")),))
    return kpis.compute_kpis(flagged_events(spark, sf_dir), EVENT_KPIS, "ts", wanted)


@query
def kpis_open_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a lower bound: the windows come from the selected rows."""
    wanted = Filters(DateRange("ts", "2024-01-12", None))
    return kpis.compute_kpis(flagged_events(spark, sf_dir), EVENT_KPIS, "ts", wanted)


# ---------- catalog of profiles ----------

CATALOG = ("orders", "events", "part", "lineitem")
_catalogs: dict[tuple, DataFrame] = {}


def catalog_types(df: DataFrame, name: str) -> dict[str, str]:
    return {p.name: p.type for p in inference.plan_columns(df)}


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when a table is rewritten: its files with their times."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in fs.listStatus(root))


def catalog_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of several tables, one row per column, computed once for the same files."""
    key = (spark.sparkContext.applicationId, sf_dir, *(_state(spark, f"{sf_dir}/{name}.parquet") for name in CATALOG))
    if key not in _catalogs:
        found = None
        for name in CATALOG:
            df = flagged_events(spark, sf_dir) if name == "events" else table(spark, sf_dir, name)
            profile = profiling.profile_table(df, catalog_types(df, name), name)
            found = profile if found is None else found.unionByName(profile)
        _catalogs[key] = handful(found, 1000)
    return _catalogs[key]


@query
def profile_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_profiles(spark, sf_dir).select("dataset_id", "name", "position", "type", "null_pct", "distinct_count")


@query
def rank_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.rank_measures(catalog_profiles(spark, sf_dir)).select("dataset_id", "name", "tier", "rank")


@query
def flag_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.flag_columns(catalog_profiles(spark, sf_dir)).select("dataset_id", "name", "rank")


@query
def column_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.column_labels(catalog_profiles(spark, sf_dir))


@query
def kpi_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.kpi_defs(catalog_profiles(spark, sf_dir))


@query
def bar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.bar_scores(catalog_profiles(spark, sf_dir)).select("dataset_id", "name", "score")


@query
def chartable_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.chartable_categories(catalog_profiles(spark, sf_dir)).select("dataset_id", "name", "rank", "score")


@query
def auto_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.auto_dashboard(catalog_profiles(spark, sf_dir))


@query
def rebuilt_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One custom widget per categorical column goes after the fresh automatic ones."""
    profiles = catalog_profiles(spark, sf_dir)
    specs = dashboards.auto_dashboard(profiles)
    none = F.lit(None).cast("string")
    custom = profiles.filter("type = 'categorical'").select(
        "dataset_id", "position", F.lit("bar").alias("chart_type"), F.concat(F.lit("My "), "name").alias("title"),
        F.col("name").alias("x"), none.alias("y"), F.lit("count").alias("aggregation"), none.alias("split"),
        none.alias("time_grain"), F.lit(None).cast("int").alias("limit"), F.lit("custom").alias("kind"),
    )
    return dashboards.rebuild_dashboard(specs, custom).select("dataset_id", "position", "kind", "title")


@query
def validated_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column on every chart type, with a y column that is not always fit."""
    profiles = catalog_profiles(spark, sf_dir)
    chart = F.explode(F.array(*map(F.lit, (*dashboards.CHART_TYPES, "pie")))).alias("chart_type")
    specs = profiles.select(
        "dataset_id", F.col("name").alias("x"), chart, F.when(F.col("position") % 2 == 0, "T").otherwise(" ").alias("title"),
        F.when(F.col("position") % 3 == 0, F.col("name")).alias("y"),
        F.when(F.col("position") == 1, "median").otherwise("sum").alias("aggregation"),
        F.when(F.col("position") % 4 == 2, "nowhere").when(F.col("position") % 4 == 3, F.col("name")).alias("split"),
    )
    checked = dashboards.validate_specs(specs, profiles.select("dataset_id", "name", "type"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("errors"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return checked.select("dataset_id", "x", "chart_type", shown.alias("errors"))


@query
def cleaned_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.clean_specs(dashboards.auto_dashboard(catalog_profiles(spark, sf_dir)).withColumn("title", F.concat(F.lit(" "), "title")))


# ---------- facts ----------


@query
def period_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cube.series_by(table(spark, sf_dir, "orders"), "o_orderdate", "month", "o_totalprice", "avg")
    return found.select("x", "value", "rows")


@query
def period_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cube.series_by(table(spark, sf_dir, "orders"), "o_orderdate", "month", "o_totalprice", "avg")
    moved = changes.period_changes(series)
    return moved.select("x", "value", "previous", fn.js_round(F.col("change"), 8).alias("change"),
                        F.col("reverts").cast("int").alias("reverts"), fn.js_round(F.col("score"), 8).alias("score"))


@query
def best_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cube.series_by(table(spark, sf_dir, "orders"), "o_orderdate", "month", "o_totalprice", "sum")
    best = changes.best_change(changes.period_changes(series))
    return best.select("x", "value", "previous", fn.js_round(F.col("change"), 8).alias("change"))


@query
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cube.series_by(table(spark, sf_dir, "events"), "ts", "hour", "value", "sum")
    return anomalies.robust_z(series).select("x", "value", fn.js_round(F.col("z"), 6).alias("z"))


@query
def anomaly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = cube.series_by(table(spark, sf_dir, "events"), "ts", "hour", "value", "avg")
    points = series.select(F.lit(0).alias("target"), F.lit(True).alias("averaged"), "bucket", "value", "rows")
    found = anomalies.anomalies(points, F.lit("day"), threshold=1.5)
    return found.select("place", fn.bucket_text(F.col("bucket"), "hour").alias("at"),
                        fn.bucket_text(F.col("chart_bucket"), "day").alias("chart_x"), "value",
                        fn.js_round(F.col("z"), 1).alias("z"))


@query
def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who explains the change of revenue from January to February 1998, either way: six stories from one scan."""
    orders = filters.filter_date_range(table(spark, sf_dir, "orders"), "o_orderdate", "1998-01-01", "1998-02-28")
    side = F.when(F.month("o_orderdate") == 2, "now").otherwise("before")
    stories = {k: story for k, story in enumerate((kind, sign) for sign in (1, -1) for kind in ("sum", "avg", "count"))}
    best = changes.drivers_of(orders, side, ["o_orderpriority", "o_orderstatus"], "o_totalprice", stories, "o_orderkey")
    of = lambda i: F.create_map(*(F.lit(x) for k, story in stories.items() for x in (k, story[i])))[F.col("story")]
    return best.select(
        of(0).alias("aggregation"), of(1).alias("sign"), "category", "key",
        fn.js_round(F.col("share"), 6).alias("share"), fn.js_round(F.col("change"), 6).alias("change"),
    )


@query
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brief.composition(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_orderkey")


def _event_facts(spark: SparkSession, sf_dir: str) -> brief.FactSet:
    profiles = catalog_profiles(spark, sf_dir).filter("dataset_id = 'events'")
    return brief.build_facts(flagged_events(spark, sf_dir), profiles, dashboards.auto_dashboard(profiles), "event_id")


@query
def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_facts(spark, sf_dir).facts()


@query
def event_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_facts(spark, sf_dir).anomalies()


@query
def event_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = _event_facts(spark, sf_dir).brief()
    return told.select("summary", F.array_join("findings", "|").alias("findings"), F.array_join("questions", "|").alias("questions"))


@query
def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = catalog_profiles(spark, sf_dir).filter("dataset_id = 'orders'")
    orders = table(spark, sf_dir, "orders")
    return brief.build_facts(orders, profiles, dashboards.auto_dashboard(profiles), "o_orderkey").facts()


# ---------- text ----------


def _joined(c: str) -> Column:
    return F.array_join(c, "|")


@query
def ungrounded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = grounding.ungrounded_numbers(documents, None, "doc_id", "text")
    return found.select("doc_id", F.size("offenders").alias("n"), _joined("offenders").alias("offenders"))


@query
def grounded_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of each document, checked against the facts its label stands for.

    Each text is followed by a claim about it that cites a fact or gives a number.
    """
    claim = F.concat(F.lit(". In "), F.col("lang"), F.lit(" on Sep 18, 2025 at 14:00 it rose {{f1}}, see "),
                     F.when(F.col("n_chars") % 3 == 0, F.concat("n_chars", F.lit("%"))).otherwise("{{f0}}"))
    parts = F.posexplode(F.split(F.concat("text", claim), r"\. ")).alias("place", "sentence")
    sentences = table(spark, sf_dir, "documents").select("doc_id", parts)
    labels = table(spark, sf_dir, "labels")
    known = labels.select("doc_id", F.explode(F.array(F.concat(F.lit("f"), "quality"), F.concat(F.lit("f"), "toxic"))).alias("fact_id"))
    return grounding.keep_grounded(sentences, known)


# ---------- events ----------


@query
def latest_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    stage = F.when(F.col("role") == "assistant", "ready").otherwise(F.col("role"))
    log = turns.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("seq"), stage.alias("stage"))
    return jobs.latest_job_state(log).withColumn("done", F.col("done").cast("int"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("seq", F.floor(F.col("value") * 10))


@query
def monotonic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    kept = jobs.monotonic_events(log, "user_id", "seq", ["ts", "event_id"], F.col("value") > 200)
    return kept.select("user_id", "event_id", "seq")


@query
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "purchase", "ready").otherwise(F.col("event_type"))
    log = events.select(F.col("user_id").alias("job_id"), stage.alias("stage"), (F.col("event_id") % 3 * 50).alias("progress"), "ts")
    return jobs.stage_durations(log)


@query
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.latency_percentiles(table(spark, sf_dir, "events"), "value").select(
        fn.js_round(F.col("p50"), 6).alias("p50"), fn.js_round(F.col("p95"), 6).alias("p95"), "max"
    )


@query
def sliding_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5 accepted events an hour per event type: few keys, so every one is hot."""
    events = table(spark, sf_dir, "events")
    limited = limiter.sliding_rate_limit(events, "event_type", "ts", "event_id")
    return limited.select("event_id", "event_type", F.col("accepted").cast("int").alias("accepted"), "retry_after")


@query
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    return jobs.purge(table(spark, sf_dir, "orders"), "o_custkey", gone).select("o_orderkey", "o_custkey")


@query
def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion messages, most of them malformed."""
    uuid = F.regexp_replace(F.md5(F.col("user_id").cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    key = F.when(F.col("event_type") == "click", uuid).otherwise(F.substring(uuid, 1, 20))
    body = F.concat(F.lit('{"workspaceId": "'), key, F.when(F.col("value") < 100, '"}').otherwise('"'))
    return jobs.deleted_keys(table(spark, sf_dir, "events").select(body.alias("data")))
