"""UTC buckets, day numbers and period labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.model import GRAINS

DAY = 86_400

# The text form of a bucket per grain.
KEY_FORMAT = {
    "hour": "yyyy-MM-dd'T'HH:00",
    "day": "yyyy-MM-dd",
    "week": "yyyy-MM-dd",
    "month": "yyyy-MM-01",
}


def known_grain(grain: str | None) -> str:
    return grain if grain in GRAINS else "day"


def bucket_start(c: Column, grain: str | None) -> Column:
    """Start of the UTC bucket. Group on this and format afterwards."""
    return F.date_trunc(known_grain(grain), c)


def bucket_text(start: Column, grain: str | None) -> Column:
    return F.date_format(start, KEY_FORMAT[known_grain(grain)])


def bucket_key(c: Column, grain: str | None) -> Column:
    """``2025-04-01``, ``2025-09-18T14:00``; also coarsens an existing key.

    Text keys are ISO days or timestamps, so a plain cast reads them as UTC.
    """
    return bucket_text(bucket_start(c.cast("timestamp"), grain), grain)


def day_index(c: Column) -> Column:
    """Whole UTC days since the epoch."""
    return F.unix_date(c.cast("date"))


def epoch_seconds(iso: Column) -> Column:
    """Epoch seconds of ISO text, with the fraction; dates are UTC midnight."""
    return F.unix_micros(iso.cast("timestamp")) / F.lit(1e6)


def period_label(key: Column, grain: Column | str) -> Column:
    """V13: "April 2025", "the week of Sep 15", "Sep 18", "14:00 on Sep 18"."""
    grain = F.lit(grain) if isinstance(grain, str) else grain
    ts = key.cast("timestamp")
    day = F.date_format(ts, "MMM d")
    return (
        F.when(grain == "month", F.date_format(ts, "MMMM yyyy"))
        .when(grain == "week", F.concat(F.lit("the week of "), day))
        .when(grain == "day", day)
        .otherwise(F.concat(F.date_format(ts, "HH:mm"), F.lit(" on "), day))
    )


def in_period(key: Column, grain: Column | str) -> Column:
    """The label with its preposition: "in April 2025", "at 14:00 on Sep 18"."""
    grain = F.lit(grain) if isinstance(grain, str) else grain
    word = (
        F.when(grain.isin("month", "week"), F.lit("in "))
        .when(grain == "day", F.lit("on "))
        .otherwise(F.lit("at "))
    )
    return F.concat(word, period_label(key, grain))


def _span(lo: Column, hi: Column) -> Column:
    return epoch_seconds(hi) - epoch_seconds(lo)


def infer_grain(lo: Column, hi: Column, month_starts: Column) -> Column:
    """Month for monthly snapshots, else by span (3, 120 and 732 days)."""
    span = _span(lo, hi)
    return (
        F.when(month_starts, F.lit("month"))
        .when(span <= 3 * DAY, F.lit("hour"))
        .when(span <= 120 * DAY, F.lit("day"))
        .when(span <= 2 * 366 * DAY, F.lit("week"))
        .otherwise(F.lit("month"))
    )


def story_grain(lo: Column, hi: Column, profiled: Column) -> Column:
    """The grain of period-over-period sentences."""
    span = _span(lo, hi)
    return (
        F.when((profiled == "month") | (span > 120 * DAY), F.lit("month"))
        .when(span > 3 * DAY, F.lit("day"))
        .otherwise(F.lit("hour"))
    )


def anomaly_grain(story: Column, lo: Column, hi: Column) -> Column:
    """One step finer than the story, unless a monthly story spans over 400 days."""
    return (
        F.when((story == "month") & (_span(lo, hi) > 400 * DAY), F.lit("month"))
        .when(story == "month", F.lit("day"))
        .otherwise(F.lit("hour"))
    )
