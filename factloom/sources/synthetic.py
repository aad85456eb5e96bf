"""A deterministic order table for load tests, from hashes of the row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The vocabulary of the benchmark table.
REGIONS = ("North America", "Europe", "Asia Pacific", "Latin America", "Middle East", "Africa")
CATEGORIES = ("Electronics", "Home & Kitchen", "Toys", "Books", "Beauty", "Sports", "Garden", "Grocery")
CHANNELS = ("Web", "Mobile app", "Marketplace", "Retail partner")


def _draw(seed: int, sides: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(sides))


def _pick(seed: int, options: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, options))[_draw(seed, len(options)).cast("int")]


def _unit(seed: int) -> Column:
    return _draw(seed, 1_000_000) / 1_000_000


def synth_orders(spark: SparkSession, rows: int = 1_000_000) -> DataFrame:
    """Twelve columns over two years; the same distributions for any ``rows``."""
    day = F.floor(F.col("id") * 730 / rows).cast("int")
    base = spark.range(rows).select(
        F.concat(F.lit("ORD-"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("order_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), day).alias("order_date"),
        _pick(1, REGIONS).alias("region"),
        _pick(2, CATEGORIES).alias("category"),
        _pick(3, CHANNELS).alias("channel"),
        F.when(_unit(7) < 0.38, "New").otherwise("Returning").alias("customer_type"),
        (_draw(4, 5) + 1).alias("quantity"),
        F.round(_unit(5) * 290 + 10, 2).alias("unit_price"),
        (_draw(6, 5) * 5).alias("discount_pct"),
        (_unit(8) < 0.04).alias("returned"),
        (_draw(9, 9) + 1).alias("shipping_days"),
    )
    revenue = F.round(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct") / 100), 2)
    return base.withColumn("revenue", revenue).select(
        "order_id", "order_date", "region", "category", "channel", "customer_type", "quantity", "unit_price",
        "discount_pct", "revenue", "returned", "shipping_days",
    )
