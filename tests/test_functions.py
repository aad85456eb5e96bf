"""Column functions on hand-made values, traps included."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import functions as fn
from factloom.functions import naming


def column(spark, values, kind, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def literal(spark, c):
    return spark.range(1).select(c).first()[0]


def test_rounds_halves_up(spark):
    values = [2.5, -2.5, -2.6, 0.125, 1e300, -1e18, None]
    assert column(spark, values, "double", lambda c: fn.js_round(c)) == [3.0, -2.0, -3.0, 0.0, 1e300, -1e18, None]
    assert column(spark, [1.005, -0.125], "double", lambda c: fn.js_round(c, 2)) == [1.0, -0.12]


def test_numbers(spark):
    given = ["$1,200.50", "12%", "-4.5", " +7 ", "€ 5", "1,20", "1e5", "٣", "", None, "\t3\n"]
    expected = [1200.5, 12.0, -4.5, 7.0, 5.0, None, None, None, None, None, 3.0]
    assert column(spark, given, "string", fn.to_number) == expected


def test_booleans(spark):
    given = ["yes", " No", "TRUE", "false", "y", "", None]
    assert column(spark, given, "string", fn.to_boolean) == [True, False, True, False, None, None, None]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2025-04-01", "2025-04-01 00:00:00"),
        ("1/31/2025", "2025-01-31 00:00:00"),
        ("2/30/2025", None),
        ("2025-02-30", None),
        ("2025-9-1", None),
        ("2025-09-18T16:05:43.123456Z", "2025-09-18 16:05:43.123"),
        ("2025-09-18 18:05+02:00", "2025-09-18 16:05:00"),
        ("2025-09-18T16:05-0530", "2025-09-18 21:35:00"),
        ("2025-09-18 10:00.5", "2025-09-18 10:00:00.5"),
        ("2025-09-18T25:00", None),
        (" 2025-04-01 ", "2025-04-01 00:00:00"),
        ("nope", None),
        ("20:00", None),
    ],
)
def test_datetimes(spark, text, expected):
    assert column(spark, [text], "string", lambda c: fn.to_datetime(c).cast("string")) == [expected]


def test_day_only_and_stripped(spark):
    assert column(spark, ["2025-04-01", "4/1/2025", "2025-04-01T10:00"], "string", fn.is_day_only) == [True, True, False]
    assert column(spark, ["  a b ", " x ", " ", None], "string", fn.stripped) == ["a b", "x", None, None]


def test_display_texts_of_doubles(spark):
    values = [3.0, 0.1, 12345678.5, 0.0005, 1.5e-7, 1e19, 1e22, -2.0, 100000000.25, None]
    texts = ["3", "0.1", "12345678.5", "0.0005", "1.5e-7", "10000000000000000000", "1e+22", "-2", "100000000.25", None]
    assert column(spark, values, "double", lambda c: fn.display_string(c, T.DoubleType())) == texts


def test_display_texts_of_other_types(spark):
    assert column(spark, [True, False, None], "boolean", lambda c: fn.display_string(c, T.BooleanType())) == ["true", "false", None]
    assert column(spark, [True, False, None], "boolean", lambda c: fn.category_key(c, T.BooleanType())) == ["Yes", "No", None]
    stamp = F.lit("2025-09-18 16:05:43.007").cast("timestamp")
    assert literal(spark, fn.iso_string(stamp, T.TimestampType())) == "2025-09-18T16:05:43.007Z"
    assert literal(spark, fn.iso_string(stamp.cast("date"), T.DateType())) == "2025-09-18"


@pytest.mark.parametrize(
    ("text", "grain", "key"),
    [
        ("2025-01-08", "week", "2025-01-06"),
        ("2025-09-18T14:32:00.000Z", "hour", "2025-09-18T14:00"),
        ("2025-02-04", "month", "2025-02-01"),
        ("2025-09-18T14:00", "day", "2025-09-18"),
        ("2025-09-18", "hour", "2025-09-18T00:00"),
        ("2025-09-18", "quarter", "2025-09-18"),
    ],
)
def test_bucket_keys(spark, text, grain, key):
    assert literal(spark, fn.bucket_key(F.lit(text), grain)) == key


@pytest.mark.parametrize(
    ("key", "grain", "label"),
    [
        ("2025-04-01", "month", "in April 2025"),
        ("2025-09-15", "week", "in the week of Sep 15"),
        ("2025-09-08", "day", "on Sep 8"),
        ("2025-09-18T14:00", "hour", "at 14:00 on Sep 18"),
    ],
)
def test_periods(spark, key, grain, label):
    assert literal(spark, fn.in_period(F.lit(key), grain)) == label


def test_day_numbers(spark):
    assert literal(spark, fn.day_index(F.lit(datetime(1970, 1, 3, 23)).cast("timestamp"))) == 2
    assert literal(spark, fn.epoch_seconds(F.lit("1970-01-02T00:00:01.500Z"))) == 86401.5
    assert literal(spark, fn.epoch_seconds(F.lit("1970-01-02"))) == 86400.0


@pytest.mark.parametrize(
    ("lo", "hi", "grain"),
    [
        ("2025-09-18T00:00:00Z", "2025-09-19T12:00:00Z", "hour"),
        ("2025-09-01", "2025-09-30", "day"),
        ("2025-01-01", "2025-12-31", "week"),
        ("2020-01-01", "2025-12-31", "month"),
    ],
)
def test_grains(spark, lo, hi, grain):
    assert literal(spark, fn.infer_grain(F.lit(lo), F.lit(hi), F.lit(False))) == grain
    assert literal(spark, fn.infer_grain(F.lit(lo), F.lit(hi), F.lit(True))) == "month"


def test_story_and_anomaly_grains(spark):
    assert literal(spark, fn.story_grain(F.lit("2025-01-01"), F.lit("2025-12-31"), F.lit("week"))) == "month"
    assert literal(spark, fn.story_grain(F.lit("2025-01-01"), F.lit("2025-01-09"), F.lit("day"))) == "day"
    assert literal(spark, fn.story_grain(F.lit("2025-01-01"), F.lit("2025-01-02"), F.lit("hour"))) == "hour"
    assert literal(spark, fn.anomaly_grain(F.lit("month"), F.lit("2025-01-01"), F.lit("2025-12-31"))) == "day"
    assert literal(spark, fn.anomaly_grain(F.lit("month"), F.lit("2023-01-01"), F.lit("2025-12-31"))) == "month"
    assert literal(spark, fn.anomaly_grain(F.lit("day"), F.lit("2025-01-01"), F.lit("2025-01-31"))) == "hour"


def test_name_heuristics(spark):
    names = ["net_revenue", "mrr", "discount_pct", "latency_ms", "seats", "warranty", "notes"]
    assert column(spark, names, "string", naming.measure_tier) == [0, 1, 7, 4, 6, 1, 7]
    assert column(spark, names, "string", fn.default_aggregation) == ["sum", "sum", "avg", "avg", "sum", "sum", "sum"]
    formats = ["currency", "currency", "percent", "duration_ms", "number", "currency", "number"]
    assert column(spark, names, "string", lambda c: fn.value_format(c, "sum")) == formats
    assert column(spark, names, "string", lambda c: fn.value_format(c, "count")) == ["number"] * 7


def test_labels(spark):
    assert column(spark, ["net_revenue", "mrr", "discount_pct", "latency_ms"], "string", fn.humanize) == [
        "Net revenue", "MRR", "Discount %", "Latency"]
    assert column(spark, ["churned", "is_error", "has_Trial"], "string", fn.flag_noun) == ["Churn", "Error", "Trial"]
    assert column(spark, ["order_id", "id", "account_id", "status"], "string", fn.entity_label) == [
        "Orders", "Records", "Accounts", "Status"]
    assert column(spark, ["revenue", None], "string", lambda c: fn.measure_label(c, "sum")) == ["Total revenue", "Rows"]
    assert column(spark, ["revenue"], "string", lambda c: fn.measure_label(c, "count_distinct")) == ["Distinct revenue"]
