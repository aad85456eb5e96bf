"""Changes, drivers, anomalies, the brief and grounding."""

import statistics

import pytest
from pyspark.sql import functions as F

from factloom.operators import anomalies, brief, changes, cube, dashboards, grounding, profiling


def series(spark, values):
    rows = [(f"2025-{i + 1:02d}-01", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "b string, value double").select(F.col("b").cast("timestamp").alias("bucket"), "value")


def test_period_changes_and_rebounds(spark):
    found = changes.period_changes(series(spark, [100, 60, 100, 0, 50, 55])).orderBy("bucket").collect()
    assert [(r["value"], round(r["change"], 4), r["reverts"], round(r["score"], 4)) for r in found] == [
        (60.0, -0.4, False, 0.5), (100.0, 0.6667, True, 0.3333), (0.0, -1.0, False, 1.25), (55.0, 0.1, False, 0.1)]
    best = changes.best_change(changes.period_changes(series(spark, [100, 60, 100]))).first()
    assert (best["value"], round(best["change"], 2)) == (60.0, -0.4)
    assert changes.best_change(changes.period_changes(series(spark, [100, 102]))).count() == 0


def test_a_change_of_five_percent_counts(spark):
    assert changes.best_change(changes.period_changes(series(spark, [2000, 1899]))).first()["change"] == pytest.approx(-0.0505)
    assert changes.best_change(changes.period_changes(series(spark, [2000, 2099]))).count() == 0


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 100], [5, 5, 5, 5, 9], [7, 7, 7]])
def test_robust_z(spark, values):
    med = statistics.median(values)
    mad = statistics.median([abs(v - med) for v in values])
    spread = (statistics.pstdev(values) or 1) if mad == 0 else 1.4826 * mad
    center = statistics.mean(values) if mad == 0 else med
    found = [r["z"] for r in anomalies.robust_z(series(spark, values)).orderBy("bucket").collect()]
    assert found == pytest.approx([(v - center) / spread for v in values])


def test_one_anomaly_per_chart_point_and_three_at_most(spark):
    rows = [("2025-01-%02d %02d:00:00" % (d, h), 10.0 + h % 3, 5) for d in range(1, 7) for h in range(24)]
    spikes = {("2025-01-02 03:00:00"): 500.0, ("2025-01-02 04:00:00"): 400.0, "2025-01-03 01:00:00": 300.0, "2025-01-04 01:00:00": -200.0, "2025-01-05 01:00:00": 100.0}
    points = spark.createDataFrame([(0, False, t, spikes.get(t, v), n) for t, v, n in rows], "target int, averaged boolean, t string, value double, rows int")
    points = points.withColumn("bucket", F.col("t").cast("timestamp"))
    found = anomalies.anomalies(points, F.lit("day")).orderBy("place").collect()
    assert [(r["place"], r["t"]) for r in found] == [(1, "2025-01-02 03:00:00"), (2, "2025-01-03 01:00:00"), (3, "2025-01-04 01:00:00")]
    assert anomalies.anomalies(points.limit(7), F.lit("day")).count() == 0


def drivers(now, before, columns, measure, aggregation, sign):
    return [tuple(r) for r in changes.find_drivers(now, before, columns, measure, aggregation, sign).collect()]


def test_drivers(spark):
    before = spark.createDataFrame([("a", "x", 100), ("b", "x", 100), ("b", "y", 50), (None, "y", 10)], "k string, m string, v long")
    now = spark.createDataFrame([("a", "x", 20), ("b", "x", 100), ("b", "y", 60), (None, "y", 10), ("new", "y", 5)], "k string, m string, v long")
    assert drivers(now, before, ["k"], "v", "sum", -1) == [("k", "a", 80 / 65, -0.8)]
    # "m" explains just as much through "x"; the column named first wins the tie.
    assert drivers(now, before, ["m", "k"], "v", "sum", -1)[0][:2] == ("m", "x")
    assert drivers(now, before, ["k", "m"], "v", "sum", -1)[0][:2] == ("k", "a")
    assert drivers(now, now, ["k"], "v", "sum", 1) == []
    assert drivers(now, before, ["k"], "v", "sum", 1) == []
    averaged = drivers(now, before, ["k"], "v", "avg", -1)
    assert averaged[0][:2] == ("k", "a") and averaged[0][3] == -0.8


@pytest.fixture(scope="module")
def shop(spark):
    """A year of orders: Books collapse in April, one day in November explodes for Toys."""
    days = spark.range(365 * 12).select(
        F.col("id").alias("n"),
        F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") / 12).cast("int")).alias("order_date"),
        F.array(*map(F.lit, ("Books", "Toys", "Garden", "Sports")))[(F.col("id") % 4).cast("int")].alias("category"),
        F.array(*map(F.lit, ("EU", "US", "APAC")))[(F.col("id") / 4 % 3).cast("int")].alias("region"),
        (F.lit(100) + F.pmod(F.xxhash64("id"), F.lit(9))).alias("base"),
    )
    april = (F.month("order_date") == 4) & (F.col("category") == "Books")
    burst = (F.col("order_date") == F.lit("2025-11-28").cast("date")) & (F.col("category") == "Toys")
    revenue = F.when(april, F.lit(5)).when(burst, F.col("base") * 40).otherwise(F.col("base")).cast("long")
    df = days.select("n", "order_date", "category", "region", revenue.alias("revenue")).persist()
    types = {"n": "id", "order_date": "datetime", "category": "categorical", "region": "categorical", "revenue": "numeric"}
    frame = profiling.profile_table(df, types, "shop")
    return df, spark.createDataFrame(frame.collect(), frame.schema)


def test_planted_story(shop):
    df, profiles = shop
    told = brief.build_facts(df, profiles, dashboards.auto_dashboard(profiles), "n")
    facts = {r["id"]: r for r in told.facts().collect()}
    rows = df.collect()
    monthly = {m: sum(r["revenue"] for r in rows if r["order_date"].month == m) for m in (3, 4)}
    books = {m: sum(r["revenue"] for r in rows if r["order_date"].month == m and r["category"] == "Books") for m in (3, 4)}
    assert facts["f1"]["value"] == sum(r["revenue"] for r in rows)
    assert facts["f2"]["label"] == "Total revenue change in April 2025"
    assert facts["f2"]["value"] == pytest.approx((monthly[4] - monthly[3]) / monthly[3], abs=1e-4)
    assert facts["f3"]["label"] == "Books total revenue change in April 2025"
    assert facts["f3"]["value"] == pytest.approx((books[4] - books[3]) / books[3], abs=1e-4)
    assert (facts["f3"]["ref_x"], facts["f3"]["ref_widget"] is not None) == ("Books", True)
    assert facts["f4"]["value"] == round(min((books[4] - books[3]) / (monthly[4] - monthly[3]), 1) * 100, 1)
    odd = told.anomalies().collect()
    assert [(r["id"], r["at"], r["direction"], r["column"]) for r in odd][:1] == [("a1", "2025-11-28", "spike", "revenue")]
    text = told.brief().first()
    assert text["summary"].startswith("Total revenue spiked to {{f5}} on Nov 28, far above the usual level, with Toys (category) accounting for {{f6}} of the jump.")
    assert "Total revenue fell {{f2}} in April 2025, driven mostly by Books (category), which moved {{f3}} and accounts for {{f4}} of the change." in text["summary"]
    assert text["summary"].endswith("Across the whole dataset, total revenue is {{f1}}.")
    assert text["questions"][:2] == ["What changed for Books in April 2025?", "Is the drop in April 2025 a one-off or the start of a trend?"]
    assert len(text["questions"]) == 3 and " is the largest " in text["findings"][-1]


def test_brief_without_a_date_or_measure(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    frame = profiling.profile_table(df, {"k": "categorical"}, "x")
    profiles = spark.createDataFrame(frame.collect(), frame.schema)
    told = brief.build_facts(df, profiles, dashboards.auto_dashboard(profiles))
    assert [tuple(r)[1:6] for r in told.facts().collect()] == [("f1", "total", "Rows", 3.0, "number")]
    assert told.brief().first()["summary"] == "Across the whole dataset, rows is {{f1}}."


def test_composition(spark):
    df = spark.createDataFrame([("a", 3), ("b", 5), (None, 2), ("b", None)], "k string, v long")
    assert [tuple(r) for r in brief.composition(df, "k", "v").collect()] == [("b", 50.0)]
    assert brief.composition(df.filter("v IS NULL"), "k", "v").count() == 0


def test_series_by(hand):
    rows = cube.series_by(hand, "day", "month", "revenue", "avg").orderBy("bucket").collect()
    assert [(r["x"], r["value"], r["rows"]) for r in rows] == [("2025-01-01", 116.6667, 3), ("2025-02-01", 30.0, 2)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Margins of 7.25 % beat the plan", ["7.25 %"]),
        ("Shipping took $3,040.50 from it", ["$3,040.50"]),
        ("The rest is in {{f9}} and {{f1}}", ["{{f9}}"]),
        ("Up {{f1}} at 08:45 on Mar 2, 2024, after 2023-12-31 and all of May 1998", []),
        ("Orders of 2021 lost +12 and −4% since July 9", ["+12", "−4%"]),
        ("{{f2}}, not 55, in week 6", ["{{f2}}", "55,", "6"]),
    ],
)
def test_grounding(spark, text, expected):
    sentences = spark.createDataFrame([("d", text)], "doc_id string, sentence string")
    facts = spark.createDataFrame([("d", "f1"), ("e", "f9")], "doc_id string, fact_id string")
    assert grounding.ungrounded_numbers(sentences, facts).first()["offenders"] == expected
    assert grounding.keep_grounded(sentences, facts).count() == (0 if expected else 1)
