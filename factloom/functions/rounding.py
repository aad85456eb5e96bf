"""V8: the rounding rule every result goes through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT_LIMIT = float(2**52)  # doubles this large have no fraction left to round


def js_round(c: Column, digits: int = 0) -> Column:
    """``floor(x * 10^d + 0.5) / 10^d``: halves go up, also below zero.

    ``F.round`` sends -2.5 to -3; this sends it to -2. ``floor`` returns a
    bigint, so values beyond its reach pass through unchanged.
    """
    c = c.cast("double")
    factor = F.lit(float(10**digits))
    scaled = c * factor
    return F.when(F.abs(scaled) < EXACT_LIMIT, F.floor(scaled + 0.5).cast("double") / factor).otherwise(c)


def finish(c: Column, aggregation: str) -> Column:
    """An aggregate's published value: empty is 0, sums 2 places, averages 4."""
    filled = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    if aggregation == "sum":
        return js_round(filled, 2)
    if aggregation == "avg":
        return js_round(filled, 4)
    return filled


def mean(total: Column, count: Column) -> Column:
    """A mean from a floating-point total.

    The total is snapped to six places first, so that the order in which tasks were
    added up cannot decide a rounding tie.
    """
    return F.try_divide(js_round(total, 6), count)
