"""Job event logs (E1-E3) and removal of deleted keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE_STAGES = ("ready", "failed")


def latest_job_state(events: DataFrame, key: str = "job_id", seq: str = "seq") -> DataFrame:
    """The event with the highest ``seq`` per job; ``done`` once ready or failed.

    Works on a batch and, in update mode, on a stream.
    """
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_last"))
    state = last.select(key, "_last.*")
    return state.withColumn("done", state["stage"].isin(*DONE_STAGES)) if "stage" in rest else state


def time_blocks(arrival: Column, grain: str = "hour") -> Column:
    """The default split of a key's history: the hour an event arrived in."""
    return F.date_trunc(grain, arrival)


def monotonic_events(
    events: DataFrame,
    key: str,
    seq: str,
    arrival: list[str],
    done: Column | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Per key, in arrival order, the events whose ``seq`` passes every earlier one,
    up to and including the first that is ``done``.

    A running maximum needs a key's history in order. ``block`` cuts that history
    into consecutive pieces (by default hours of the first arrival column), so a
    key with a third of all rows spreads over many tasks: each block is scanned on
    its own, and the maxima of earlier blocks, one row per block, are added.
    """
    block = time_blocks(F.col(arrival[0])) if block is None else block
    tagged = events.withColumn("_block", block)
    peaks = tagged.groupBy(key, "_block").agg(F.max(seq).alias("_peak"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = peaks.select(F.col(key).alias("_k"), F.col("_block").alias("_b"), F.max("_peak").over(earlier).alias("_carried"))
    inside = Window.partitionBy(key, "_block").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    # NULL-safe: greatest() skips nulls, and a key's first event has neither.
    last = F.greatest("_carried", F.max(seq).over(inside))
    kept = (
        # Events without a key are one key's, those without an arrival time one block, the first.
        tagged.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_block").eqNullSafe(F.col("_b")))
        .withColumn("_last", last)
        .filter(F.col("_last").isNull() | (F.col(seq) > F.col("_last")))
    )
    kept = kept.drop("_block", "_carried", "_last", "_k", "_b")
    if done is None:
        return kept.select(*events.columns)
    # Forwarded events have rising seq, so the first done one is the one with the lowest seq.
    ends = kept.filter(done).groupBy(F.col(key).alias("_k")).agg(F.min(seq).alias("_end"))
    return kept.join(ends, F.col(key).eqNullSafe(F.col("_k")), "left").filter(F.col("_end").isNull() | (F.col(seq) <= F.col("_end"))).select(*events.columns)


def stage_durations(events: DataFrame, started: DataFrame | None = None) -> DataFrame:
    """``(job_id, mark, seconds)``: when each stage@progress, and the end, was reached.

    Counted from the job's own start time (``started``: job_id, started_at), else
    from its first event. A done event gives the ``done`` mark.
    """
    mark = F.when(F.col("stage").isin(*DONE_STAGES), F.lit("done")).otherwise(
        F.concat_ws("@", "stage", F.col("progress").cast("string"))
    )
    marks = events.groupBy("job_id", mark.alias("mark")).agg(F.min("ts").alias("_first"))
    if started is None:
        starts = marks.groupBy("job_id").agg(F.min("_first").alias("started_at"))
    else:
        starts = started.select("job_id", "started_at")
    elapsed = (F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return marks.join(starts, "job_id").select("job_id", "mark", elapsed.alias("seconds"))


def deleted_keys(messages: DataFrame, payload: str = "data", field: str = "workspaceId") -> DataFrame:
    """``key`` of well-formed deletion messages; malformed ones are ignored."""
    raw = F.get_json_object(payload, f"$.{field}")
    uuid = r"(?i)^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$"
    plain = F.lower(F.regexp_replace(raw, "-", ""))
    key = F.concat_ws("-", *(F.substring(plain, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return messages.filter(raw.rlike(uuid)).select(key.alias("key")).distinct()


def purge(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Without every row of the deleted keys."""
    gone = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    return df.join(gone, column, "left_anti").select(*df.columns)
