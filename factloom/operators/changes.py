"""Period changes (F2) and what drove them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.calendar import bucket_start
from factloom.functions.rounding import finish, mean
from factloom.functions.text import display_string
from factloom.operators.aggregates import number_column
from factloom.operators.cube import ALL

REVERT_WITHIN = 0.1
FALL_WEIGHT, REVERT_WEIGHT = 1.25, 0.5
LEAST_CHANGE = 0.05
LEAST_SHARE = 0.3


def period_changes(series: DataFrame) -> DataFrame:
    """F2: ``previous``, ``change``, ``reverts`` and ``score`` per bucket.

    Buckets are bounded by the calendar, so one ordered window is safe; "previous"
    is the previous existing bucket.
    """
    order = Window.orderBy("bucket")
    two_back = F.lag("value", 2).over(order)
    previous = F.lag("value", 1).over(order)
    value = F.col("value")
    moved = series.withColumn("previous_bucket", F.lag("bucket", 1).over(order)).withColumn("previous", previous)
    change = F.try_divide(value - F.col("previous"), F.abs(F.nullif("previous", F.lit(0.0))))
    reverts = F.coalesce(F.try_divide(F.abs(value - two_back), F.abs(F.nullif(two_back, F.lit(0.0)))) <= REVERT_WITHIN, F.lit(False))
    weight = F.when(F.col("reverts"), REVERT_WEIGHT).otherwise(1.0) * F.when(F.col("change") < 0, FALL_WEIGHT).otherwise(1.0)
    return (
        moved.withColumn("change", change)
        .withColumn("reverts", reverts)
        .filter(F.col("change").isNotNull())
        .withColumn("score", F.abs("change") * weight)
    )


def best_change(changes: DataFrame) -> DataFrame:
    """F2: the highest score, the earliest on ties, if it moved at least 5 %."""
    return changes.orderBy(F.desc("score"), F.asc("bucket")).limit(1).filter(F.abs("change") >= LEAST_CHANGE)


def _side(name: str, state: str) -> Column:
    return F.sum(F.when(F.col("side") == name, F.col(state)))


def rank_drivers(cells: DataFrame, aggregation: Column) -> DataFrame:
    """F5, F6 for many comparisons at once.

    ``cells`` holds cube rows tagged with ``story``, ``sign``, ``side`` (now or
    before) and ``category_rank``. A conditional aggregate puts both sides of a
    category on one row, and one window per story picks the best share. The
    comparison's own total comes from the pseudo-category of all rows.
    """

    tagged = cells.withColumn("_aggregation", aggregation)
    aggregation = F.col("_aggregation")

    def published(side: str) -> tuple[Column, Column]:
        rows, total = F.coalesce(_side(side, "rows"), F.lit(0)).cast("double"), _side(side, "total")
        counted = aggregation == "count"
        whole = F.when(counted, rows).otherwise(finish(total, "sum"))
        return whole, F.when(aggregation == "avg", finish(mean(total, _side(side, "filled")), "avg")).otherwise(whole)

    (now_total, now_value), (before_total, before_value) = published("now"), published("before")
    keys = ["story", "category", "category_rank", "key"]
    sides = tagged.groupBy(*keys, "sign", "_aggregation").agg(
        now_total.alias("now_total"),
        now_value.alias("now_value"),
        before_total.alias("before_total"),
        before_value.alias("before_value"),
        F.min(F.when(F.col("side") == "now", 0).otherwise(1)).alias("seen"),
        F.min_by("first", F.when(F.col("side") == "now", 0).otherwise(1)).alias("first"),
    )
    delta = sides.filter(F.col("category") == ALL).select(
        "story", (F.col("now_total") - F.col("before_total")).alias("delta")
    )
    shares = (
        sides.filter((F.col("category") != ALL) & (F.col("before_value") != 0))
        .join(delta.filter("delta <> 0"), "story")
        .withColumn("share", (F.col("now_total") - F.col("before_total")) / F.col("delta"))
        .withColumn("change", (F.col("now_value") - F.col("before_value")) / F.abs("before_value"))
        .filter((F.signum("change") == F.col("sign")) & (F.col("share") >= LEAST_SHARE))
    )
    order = [F.desc("share"), F.asc("category_rank"), F.asc("seen"), F.asc_nulls_last("first"), F.asc("key")]
    best = F.row_number().over(Window.partitionBy("story").orderBy(*order))
    return shares.withColumn("rank", best).filter("rank = 1").select("story", "category", "key", "share", "change")


def compared_cells(cube: DataFrame, comparisons: DataFrame, grain: Column | str, categories: list[str]) -> DataFrame:
    """Cube rows of the two buckets of each comparison, tagged for ``rank_drivers``.

    ``comparisons`` has ``(story, bucket, previous_bucket, sign, flag)``, a handful
    of rows by construction, so it is broadcast.
    """
    sides = comparisons.select(
        "story",
        "sign",
        "flag",
        F.explode(F.create_map(F.lit("now"), F.col("bucket"), F.lit("before"), F.col("previous_bucket"))).alias("side", "_at"),
    )
    ranks = F.create_map(F.lit(ALL), F.lit(-1), *(x for i, c in enumerate(categories) for x in (F.lit(c), F.lit(i))))
    total = F.when(F.col("flag"), F.col("flagged")).otherwise(F.col("total"))
    return (
        cube.withColumn("_at", bucket_start(F.col("bucket"), grain))
        .join(F.broadcast(sides), "_at")
        .withColumn("total", total)
        .withColumn("category_rank", ranks[F.col("category")])
    )


def find_drivers(
    now: DataFrame,
    before: DataFrame,
    categories: list[str],
    measure: str | None,
    aggregation: str,
    sign: int,
    order_by: str | None = None,
) -> DataFrame:
    """F5, F6 between two sets of rows: the category value that explains most of a change.

    One row ``(category, key, share, change)`` or none. A single column gives F5,
    several give F6.
    """
    both = now.withColumn("_side", F.lit("now")).unionByName(before.withColumn("_side", F.lit("before")))
    return drivers_of(both, F.col("_side"), categories, measure, {0: (aggregation, sign)}, order_by).drop("story")


def drivers_of(
    df: DataFrame,
    side: Column,
    categories: list[str],
    measure: str | None,
    stories: dict[int, tuple[str, int]],
    order_by: str | None = None,
) -> DataFrame:
    """F5, F6 for several stories over the same rows, from one scan: ``(story, category, key, share, change)``.

    ``side`` tells rows ``now`` from those ``before``; a story is an aggregation of
    the measure and the sign of the change it explains.
    """
    m = number_column(df, measure) if measure else F.lit(None).cast("double")
    shown = {f"_c{i}": display_string(F.col(c), df.schema[c].dataType) for i, c in enumerate(categories)}
    rows = df.select(
        side.alias("side"),
        m.alias("_m"),
        (F.col(order_by) if order_by else F.lit(None).cast("int")).alias("_o"),
        F.lit(ALL).alias("_all"),
        *(c.alias(n) for n, c in shown.items()),
    )
    rows = rows.unpivot(["side", "_m", "_o"], ["_all", *shown], "_column", "key").filter(F.col("key").isNotNull())
    cells = rows.groupBy("side", "_column", "key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_m").alias("total"), F.count("_m").alias("filled"), F.min("_o").alias("first")
    )
    names = F.create_map(F.lit("_all"), F.lit(ALL), *(x for i, c in enumerate(categories) for x in (F.lit(f"_c{i}"), F.lit(c))))
    ranks = F.create_map(F.lit("_all"), F.lit(-1), *(x for i in range(len(categories)) for x in (F.lit(f"_c{i}"), F.lit(i))))
    told = [F.struct(F.lit(k).alias("story"), F.lit(kind).alias("aggregation"), F.lit(sign).alias("sign")) for k, (kind, sign) in stories.items()]
    tagged = cells.select("*", names[F.col("_column")].alias("category"), ranks[F.col("_column")].alias("category_rank"), F.inline(F.array(*told)))
    return rank_drivers(tagged, F.col("aggregation"))
