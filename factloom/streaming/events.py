"""Job events and rate limits on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.jobs import DONE_STAGES, latest_job_state
from factloom.operators.limiter import LIMIT, WINDOW_SECONDS, decide


def job_states(events: DataFrame) -> DataFrame:
    """E1 on a stream; write it in update mode."""
    return latest_job_state(events)


def monotonic_stream(
    events: DataFrame, key: str, seq: str, arrival: list[str], stage: str | None = None
) -> DataFrame:
    """E2 on a stream: state per key is the last forwarded ``seq`` and whether it was done."""

    def forward(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done = state.get if state.exists else (None, False)
        rows = pd.concat(list(chunks)).sort_values(arrival, kind="stable")
        earlier = rows[seq].cummax().shift()
        if last is not None:
            earlier = earlier.fillna(last).clip(lower=last)
        kept = rows[(rows[seq] > earlier) | earlier.isna()] if not done else rows.iloc[:0]
        if stage and len(kept):
            ends = kept[stage].isin(DONE_STAGES).to_numpy()
            if ends.any():
                kept, done = kept.iloc[: int(ends.argmax()) + 1], True
        if len(kept):
            last = int(kept[seq].iloc[-1])
        if last is not None:
            state.update((int(last), bool(done)))
        yield kept

    return events.groupBy(key).applyInPandasWithState(
        forward, events.schema, "last long, done boolean", "append", GroupStateTimeout.NoTimeout
    )


def rate_limit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    limit: int = LIMIT,
    window_seconds: int = WINDOW_SECONDS,
    watermark: str | None = None,
) -> DataFrame:
    """E5 on a stream: state per key is at most ``limit`` accepted instants.

    A key's rows of one micro-batch are decided together, so size batches by the
    source's rate options. With a ``watermark`` delay the state of a key is dropped
    a window after its last accepted event.
    """
    window = window_seconds * 1_000_000
    micros = T.StructField("_at", T.LongType())
    out = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType()), T.StructField("retry_after", T.LongType())])
    names = out.fieldNames()

    def verdicts(_: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(chunks)).sort_values([micros.name, row_id], kind="stable")
        times, first, counts = np.unique(rows[micros.name].to_numpy(), return_index=True, return_counts=True)
        accepted, oldest = decide(times, counts, held, limit, window)
        place = np.arange(len(rows)) - np.repeat(first, counts)
        rows["accepted"] = place < np.repeat(accepted, counts)
        wait = -((np.repeat(times, counts) - window - np.repeat(oldest, counts)) // 1_000_000)
        rows["retry_after"] = pd.array(np.where(rows["accepted"], 0, np.maximum(1, wait)), dtype="Int64")
        rows.loc[rows["accepted"], "retry_after"] = pd.NA
        state.update((held,))
        if watermark and held:
            expires = (held[-1] + window) // 1000
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs() + 1))
        yield rows[names]

    timed = events.withWatermark(ts, watermark) if watermark else events
    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    return (
        timed.withColumn(micros.name, F.unix_micros(F.col(ts).cast("timestamp")))
        .groupBy(key)
        .applyInPandasWithState(verdicts, out, "held array<long>", "append", timeout)
    )


def once(stream: DataFrame, handle: Callable[[DataFrame, int], Any], checkpoint: str) -> None:
    """Runs a stream over everything available, then stops: a catch-up batch."""
    query = (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
