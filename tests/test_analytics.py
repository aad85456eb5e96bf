"""Filters, aggregation, charts, KPIs and dashboards on hand tables."""

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import display_string
from factloom.model import DateRange, Filters, WhereIn, WidgetSpec
from factloom.operators import aggregates, charts, dashboards, filters, kpis, measures, paging
from factloom.plans.dashboard import dashboard_query

PROFILE = (
    "dataset_id string, name string, position int, type string, null_pct double, distinct_count long, "
    "numeric struct<min:double,max:double,mean:double,median:double,p95:double,sum:double>, "
    "datetime struct<min:string,max:string,grain:string>, top array<struct<value:string,count:bigint>>"
)


def profile(name, kind, position, distinct=10, counts=None, span=None, null_pct=0.0, dataset="d"):
    top = [(f"v{i}", c) for i, c in enumerate(counts)] if counts is not None else None
    return (dataset, name, position, kind, null_pct, len(counts) if counts is not None else distinct, None, span, top)


def points(df):
    return [(r["x"], r["series"], r["value"]) for r in df.orderBy("x_ord", "series_ord").collect()]


def test_filters_by_range_and_values(hand):
    wanted = Filters(DateRange("day", "2025-01-07", "2025-01-31"), (WhereIn("region", ("EU", "US")),))
    assert [r["revenue"] for r in filters.apply_filters(hand, wanted).orderBy("n").collect()] == [50, 200]


def test_filters_that_do_nothing_or_everything(hand):
    assert filters.filter_date_range(hand, "gone", "2025-01-01").count() == 5
    assert filters.filter_date_range(hand, "day").count() == 5
    assert filters.filter_date_range(hand, "region", "2025-01-01").count() == 0
    assert filters.filter_date_range(hand, "day", "2025-02", None).count() == 2
    assert filters.filter_where_in(hand, "region", []).count() == 5
    assert filters.filter_where_in(hand, "ok", ["true"]).count() == 3
    assert filters.filter_where_in(hand, "revenue", ["30", "030"]).count() == 1
    assert filters.filter_where_in(hand, "day", ["2025-01-06"]).count() == 1
    cleaned = filters.clean_filters(hand, Filters(DateRange("other", "2025-01-07"), (WhereIn("gone", ("a",)), WhereIn("ok", ()))), "day")
    assert cleaned == Filters(DateRange("day", "2025-01-07", None), ())


def test_request_form():
    body = {"dateRange": {"column": "day", "from": "a"}, "where": [{"column": "c", "op": "in", "values": [1]}, 5, {"values": [2]}]}
    assert Filters.from_json(body) == Filters(DateRange("day", "a", None), (WhereIn("c", (1,)),))
    assert Filters.from_json(None) == Filters(None, ())


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_day_filters_reach_the_scan(spark, hand, tmp_path, kind):
    path = str(tmp_path / kind)
    hand.withColumn("day", F.col("day").cast(kind)).write.parquet(path)
    df = filters.filter_date_range(spark.read.parquet(path), "day", "2025-01-07", "2025-01-14")
    assert [r["n"] for r in df.orderBy("n").collect()] == [1, 2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day" in plan and "PushedFilters" in plan


def test_presets(spark):
    df = spark.sql("SELECT timestamp'2025-12-31 23:00:00' AS t UNION ALL SELECT timestamp'2025-03-01 00:00:00'")

    def resolve(*a):
        return filters.resolve_date_range(df, "t", *a)

    assert resolve("7d") == DateRange("t", "2025-12-25", "2025-12-31")
    assert resolve("90d") == DateRange("t", "2025-10-03", "2025-12-31")
    assert resolve("ytd") == DateRange("t", "2025-01-01", "2025-12-31")
    assert resolve("custom", "2025-02-01", "2025-01-01") == DateRange("t", "2025-01-01", "2025-02-01")
    assert resolve("custom", "2025-2-1", "2025-01-01") is None and resolve("all") is None


def test_sorting_and_pages(hand):
    assert [r["revenue"] for r in paging.sort_rows(hand, "revenue", "desc").collect()] == [200, 100, 50, 30, None]
    assert [r["revenue"] for r in paging.sort_rows(hand, "revenue").collect()] == [30, 50, 100, 200, None]
    page = paging.rows_page(hand, None, "revenue:desc", "2", "25", ["n"])
    assert page.count() == 0
    assert paging.rows_total(hand).first()["total"] == 5
    pages = [paging.rows_page(hand, page=k, page_size=25).select("n").collect() for k in (1, 2)]
    assert sorted(r["n"] for p in pages for r in p) == [0, 1, 2, 3, 4]
    first = paging.rows_page(hand, None, "nothing:desc", "x", 7, ["n"]).orderBy("row_no").collect()
    assert [(r["n"], r["row_no"], r["total"]) for r in first] == [(i, i + 1, 5) for i in range(5)]
    assert [tuple(r) for r in paging.filter_values(hand, "region", "u").collect()] == [("EU", 2), ("US", 1)]


@pytest.mark.parametrize(
    ("column", "aggregation", "expected"),
    [("revenue", "sum", 380), ("revenue", "avg", 95), ("revenue", "count", 5), ("region", "count_distinct", 3), ("ok", "avg", 0.75),
     ("ok", "sum", 3), ("ok", "max", 1), ("revenue", "min", 30), ("region", "sum", 0), ("gone", "avg", 5), (None, "count", 5)],
)
def test_aggregates(hand, column, aggregation, expected):
    assert aggregates.aggregate(hand, column, aggregation).first()["value"] == expected
    empty = aggregates.aggregate(hand.filter("n > 9"), column, aggregation).first()["value"]
    assert empty == 0
    if column == "revenue" and aggregation == "sum":
        assert aggregates.aggregate(hand, column, aggregation, F.col("region") == "EU").first()["value"] == 150


def test_monthly_series(hand):
    spec = WidgetSpec("line", "day", "sum", "revenue", time_grain="month")
    assert points(charts.time_series(hand, spec)) == [("2025-01-01", "value", 350.0), ("2025-02-01", "value", 30.0)]
    assert charts.time_series(hand, WidgetSpec("line", "region", "sum", "revenue")).count() == 0


def test_zero_fill_only_for_sums_and_counts(hand):
    filled = points(charts.time_series(hand, WidgetSpec("line", "day", "sum", "revenue", split="region", time_grain="month"), "n"))
    assert filled == [("2025-01-01", "US", 200.0), ("2025-01-01", "EU", 150.0), ("2025-01-01", "APAC", 0.0),
                      ("2025-02-01", "US", 0.0), ("2025-02-01", "EU", 0.0), ("2025-02-01", "APAC", 30.0)]
    sparse = points(charts.time_series(hand, WidgetSpec("line", "day", "avg", "revenue", split="region", time_grain="month"), "n"))
    assert sparse == [("2025-01-01", "US", 200.0), ("2025-01-01", "EU", 75.0), ("2025-02-01", "APAC", 30.0)]


def test_top_categories_and_other(hand):
    spec = WidgetSpec("bar", "region", "sum", "revenue", limit=2)
    assert points(charts.category_series(hand, spec)) == [("US", "value", 200.0), ("Other", "value", 180.0)]
    average = WidgetSpec("bar", "region", "avg", "revenue", limit=2)
    assert points(charts.category_series(hand, average)) == [("US", "value", 200.0), ("Other", "value", 60.0)]
    booleans = WidgetSpec("bar", "ok", "count")
    assert points(charts.category_series(hand, booleans)) == [("Yes", "value", 3.0), ("No", "value", 1.0)]


def test_ties_follow_first_appearance(spark):
    rows = [(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")]
    df = spark.createDataFrame(rows, "n int, k string")
    assert points(charts.category_series(df, WidgetSpec("bar", "k", "count"), "n"))[0][0] == "b"
    assert points(charts.category_series(df, WidgetSpec("bar", "k", "count")))[0][0] == "a"


def test_a_real_other_merges_with_the_fold(spark):
    df = spark.createDataFrame([("Other",)] * 4 + [("a",)] * 3 + [("b",)] * 2 + [("c",)], "k string")
    assert points(charts.category_series(df, WidgetSpec("bar", "k", "count", limit=3))) == [("a", "value", 3.0), ("Other", "value", 7.0)]


def test_category_without_split_rows_keeps_its_place(spark):
    rows = [("a", None, 9), ("b", "s", 1), ("b", "t", 2), ("b", "t", 3)]
    df = spark.createDataFrame(rows, "k string, s string, v long")
    found = points(charts.category_series(df, WidgetSpec("bar", "k", "max", "v", split="s")))
    assert found == [("a", "t", 0.0), ("a", "s", 0.0), ("b", "t", 3.0), ("b", "s", 1.0)]


def test_histograms(spark, hand):
    found = charts.histogram(hand, "revenue").orderBy("x_ord").collect()
    assert len(found) == 20 and sum(r["value"] for r in found) == 4 and found[-1]["value"] == 1
    unit = charts.histogram(spark.createDataFrame([(1,), (3,), (3,)], "v int"), "v").orderBy("x_ord").collect()
    assert [tuple(r)[:3] for r in unit] == [(1.0, 2.0, 1.0), (2.0, 3.0, 0.0), (3.0, 4.0, 2.0)]
    flat = charts.histogram(spark.createDataFrame([(0.5,)] * 3, "v double"), "v").orderBy("x_ord").collect()
    assert len(flat) == 20 and flat[0]["value"] == 3 and flat[0]["x2"] == 0.55
    assert charts.histogram(hand, "region").count() == 0
    assert charts.histogram(hand.filter("revenue IS NULL"), "revenue").count() == 0


def test_kpis_compare_windows(spark, hand):
    profiles = spark.createDataFrame(
        [profile("day", "datetime", 0), profile("region", "categorical", 1), profile("revenue", "numeric", 2)], PROFILE)
    found = {r["id"]: r for r in kpis.compute_kpis(hand, profiles, "day", Filters(DateRange("day", "2025-01-13", "2025-01-19"))).collect()}
    revenue = found["m:revenue"]
    assert (revenue["value"], revenue["delta"], revenue["delta_label"], revenue["format"]) == (200.0, 0.3333, "vs previous 7 days", "currency")
    assert found["rows"]["delta"] == -0.5
    everything = {r["id"]: r for r in kpis.compute_kpis(hand, profiles, "day").collect()}
    assert everything["m:revenue"]["delta_label"] == "Last 15 days vs prior 15"
    assert kpis.compute_kpis(hand, profiles, None).filter("delta IS NOT NULL").count() == 0
    nothing = Filters(None, (WhereIn("region", ("Mars",)),))
    assert [r["value"] for r in kpis.compute_kpis(hand, profiles, "day", nothing).orderBy("ord").collect()] == [0.0, 0.0]


def test_kpis_with_distinct_counts(hand):
    def strip(*columns):
        defs = [kpis.Kpi(c, c, c, "count_distinct", "number") for c in columns]
        defs += [kpis.Kpi("sum", "s", "revenue", "sum", "number"), kpis.Kpi("max", "m", "revenue", "max", "number"),
                 kpis.Kpi("rate", "r", "ok", "avg", "percent", 100.0), kpis.Kpi("rows", "n", None, "count", "number")]
        wanted = Filters(DateRange("day", "2025-01-01", "2025-01-31"))
        return {r["id"]: (r["value"], r["delta"]) for r in kpis.compute_kpis(hand, defs, "day", wanted).collect()}

    rest = {"sum": (350.0, None), "max": (200.0, None), "rate": (66.67, None), "rows": (3.0, None)}
    assert strip("region") == {"region": (2.0, None), **rest}
    assert strip("region", "ok") == {"region": (2.0, None), "ok": (2.0, None), **rest}


@pytest.mark.parametrize("split", [None, "region"])
def test_a_dashboard_equals_its_widgets(hand, split):
    widgets = {
        "line": WidgetSpec("line", "day", "sum", "revenue", time_grain="month", split=split),
        "area": WidgetSpec("area", "day", "avg", "ok", time_grain="week"),
        "bar": WidgetSpec("bar", "region", "avg", "revenue", limit=2),
        "low": WidgetSpec("bar", "region", "min", "revenue", split="ok"),
        "donut": WidgetSpec("donut", "ok", "count_distinct", "region"),
        "none": WidgetSpec("bar", "ok", "sum", "region"),
        "bins": WidgetSpec("histogram", "revenue"),
    }
    wanted = Filters(DateRange("day", "2025-01-01", "2025-02-28"), (WhereIn("region", ("EU", "US", "APAC")),))
    result = dashboard_query(hand, widgets, wanted, date_column="day", order_by="n")
    alone = filters.apply_filters(hand, wanted)
    for widget_id, spec in widgets.items():
        one = charts.run_widget(alone, spec, widget_id, "n")
        assert sorted(map(str, result.points.filter(F.col("widget_id") == widget_id).collect())) == sorted(map(str, one.collect())), widget_id
    result.release()


def test_bar_scores(spark):
    cases = [profile("a", "categorical", 0, counts=[344, 300, 200, 100, 56]), profile("b", "categorical", 1, counts=[930, 30, 20, 10, 5, 5]),
             profile("c", "categorical", 2, counts=[100] * 5), profile("d", "categorical", 3, counts=[])]
    scores = dashboards.bar_scores(spark.createDataFrame(cases, PROFILE)).orderBy("position").collect()
    assert [r["score"] for r in scores] == [0.744, 0.505, 0.6, 0.0]


def specs_of(spark, rows):
    return dashboards.auto_dashboard(spark.createDataFrame(rows, PROFILE)).orderBy("dataset_id", "position").collect()


def test_auto_dashboard_of_a_subscription_table(spark):
    """Several datasets at once; the second has a flag, a donut and an averaged measure."""
    month = ("2024-01-01", "2025-12-01", "month")
    first = [profile("month", "datetime", 0, 24, span=month), profile("account_id", "id", 1, 743),
             profile("plan", "categorical", 2, counts=[60, 30, 10]), profile("country", "categorical", 3, counts=[20] * 8),
             profile("seats", "numeric", 4, 40), profile("mrr", "numeric", 5, 300), profile("churned", "boolean", 6, 2)]
    day = ("2025-09-01T00:00:00.000Z", "2025-09-30T23:00:00.000Z", "day")
    second = [profile("timestamp", "datetime", 0, 900, span=day, dataset="e"), profile("method", "categorical", 1, counts=[9, 1], dataset="e"),
              profile("device", "categorical", 2, counts=[5, 4, 1], dataset="e"), profile("path", "categorical", 3, counts=[6] * 4, dataset="e"),
              profile("latency_ms", "numeric", 4, 99, dataset="e"), profile("is_error", "boolean", 5, 2, dataset="e")]
    found = specs_of(spark, first + second)
    assert [(r["chart_type"], r["title"]) for r in found if r["dataset_id"] == "d"] == [
        ("line", "Total MRR by month"), ("line", "Churn by month"), ("bar", "Total MRR by plan"), ("bar", "Total MRR by country"),
        ("histogram", "Distribution of MRR")]
    assert [(r["chart_type"], r["title"], r["x"]) for r in found if r["dataset_id"] == "e"] == [
        ("line", "Average latency by day", "timestamp"), ("area", "Rows by day", "timestamp"), ("line", "Error by day", "timestamp"),
        ("bar", "Average latency by device", "device"), ("bar", "Average latency by path", "path"),
        ("bar", "Average latency by method", "method"), ("histogram", "Distribution of latency", "latency_ms")]


def test_donut_is_taken_before_the_bars(spark):
    rows = [profile(n, "categorical", i, counts=[5, 3, 2]) for i, n in enumerate("abcd")] + [profile("revenue", "numeric", 9, 50)]
    assert [(r["chart_type"], r["x"], r["title"]) for r in specs_of(spark, rows)] == [
        ("bar", "a", "Total revenue by a"), ("bar", "b", "Total revenue by b"), ("donut", "c", "Share of revenue by c"),
        ("histogram", "revenue", "Distribution of revenue")]


def test_the_best_scoring_bar_leads(spark):
    rows = [profile("status", "categorical", 0, counts=[930, 30, 20, 10, 5, 5]), profile("region", "categorical", 1, counts=[344, 300, 200, 100, 56])]
    assert [r["x"] for r in specs_of(spark, rows) if r["chart_type"] == "bar"] == ["region", "status"]


def test_measures_and_kpi_defs(spark):
    rows = [profile("account_id", "id", 0), profile("price", "numeric", 1), profile("mrr", "numeric", 2), profile("one", "numeric", 3, 1),
            profile("seats", "numeric", 4), profile("churned", "boolean", 5)]
    frame = spark.createDataFrame(rows, PROFILE)
    assert [r["name"] for r in measures.rank_measures(frame).orderBy("rank").collect()] == ["mrr", "price", "seats"]
    assert [(k.id, k.label, k.aggregation, k.format, k.scale) for k in kpis.kpi_list(frame)] == [
        ("entities", "Accounts", "count_distinct", "number", 1.0), ("m:mrr", "Total MRR", "sum", "currency", 1.0),
        ("m:price", "Average price", "avg", "currency", 1.0), ("rate:churned", "Churn rate", "avg", "percent", 100.0)]


def test_where_in_reaches_the_scan_and_texts_decide(spark, tmp_path):
    """Doubles and timestamps: ranges are pushed, and only values with the very text match."""
    rows = [(0.1,), (0.1 + 4e-13,), (0.05,), (-0.0,), (0.0,), (3.0,), (1e17,), (123456789.125,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "v double").withColumn("t", F.expr("timestamp_micros(cast(least(coalesce(nanvl(v, 0), 0), 1e9) * 1000 AS bigint))"))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    shown = {c: df.withColumn("shown", display_string(F.col(c), df.schema[c].dataType)) for c in ("v", "t")}
    texts = ["0.1", "0.10", "0.05", "0", "3", "100000000000000000", "123456789.125", "x", "NaN"]
    for values in (texts, texts[:-1], ["0.1"], ["x"]):
        want = sorted(map(repr, shown["v"].filter(F.col("shown").isin(values)).drop("shown").collect()))
        assert sorted(map(repr, filters.filter_where_in(df, "v", values).collect())) == want
    for values in (["1970-01-01T00:00:00.000Z", "1970-01-01T00:00:00.003Z", "soon"], ["1970-01-01"], ["+12000-01-01T00:00:00.000Z"]):
        want = sorted(map(repr, shown["t"].filter(F.col("shown").isin(values)).drop("shown").collect()))
        assert sorted(map(repr, filters.filter_where_in(df, "t", values).collect())) == want
    plan = lambda c, values: filters.filter_where_in(df, c, values)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v" in plan("v", ["0.1"]) and "GreaterThanOrEqual(t" in plan("t", ["1970-01-01T00:00:00.003Z"])


def test_seek_index_gives_the_same_pages(spark):
    """Every page beside ``rows_page``, nulls and ties among the keys; few ranges are sorted for a deep one."""
    df = spark.range(0, 3000, 1, 5).selectExpr("id AS n", "if(id % 7 = 0, null, id % 50) AS v")
    index = paging.SeekIndex(df, None, "v:desc", ["n"], ranges=12)
    assert index.total == 3000 and len(index.sizes) == 12
    for number in (1, 7, 12, 13, 40):
        want = paging.rows_page(df, None, "v:desc", number, 250, ["n"]).collect()
        assert sorted(index.page(number, 250).collect()) == sorted(want)
    read = [r["_range"] for r in index.table.filter("_range IN (3)").select("_range").distinct().collect()]
    assert read == [3]
    index.release()
    empty = paging.SeekIndex(df.filter("n < 0"), None, "v", ["n"])
    assert empty.total == 0 and empty.page(1).count() == 0
