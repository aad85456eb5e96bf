"""E5: a sliding-window rate limit per key.

An event is accepted when fewer than ``limit`` accepted events are younger than
the window; rejected events do not count. Each verdict depends on the ones before
it, so a key's history is decided in order. What can be taken out of that order is:

- events of one key and instant are counted before anything else moves;
- a pause of a whole window forgets everything, so a history is cut there, found
  on one row per key and window-long slot;
- a run with no more events than the limit is accepted as a whole, without Python.

Only the remaining runs are read in order, as instants with counts, in batches and
with at most ``limit`` remembered instants per run, so no run is held in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 5
WINDOW_SECONDS = 3600


def decide(times: np.ndarray, counts: np.ndarray, held: list[int], limit: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Accepted events per instant (sorted microseconds) and the oldest one still held.

    ``held`` are the accepted instants of the run so far, at most ``limit``; it is
    updated in place. While it is full, instants younger than a window after the
    oldest are skipped in one step.
    """
    accepted = np.zeros(len(times), dtype=np.int64)
    oldest = np.full(len(times), -1, dtype=np.int64)
    i = 0
    while i < len(times):
        now = int(times[i])
        while held and now - held[0] >= window:
            held.pop(0)
        room = limit - len(held)
        if room == 0:
            end = int(np.searchsorted(times, held[0] + window, side="left"))
            oldest[i:end] = held[0]
            i = end
            continue
        taken = min(room, int(counts[i]))
        accepted[i] = taken
        held.extend([now] * taken)
        oldest[i] = held[0]
        i += 1
    return accepted, oldest


def _walker(limit: int, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, held = None, []
        for batch in batches:
            parts = []
            for current, rows in batch.groupby("run", sort=False):
                if current != run:
                    run, held = current, []
                accepted, oldest = decide(rows["at"].to_numpy(), rows["n"].to_numpy(), held, limit, window)
                parts.append(rows[["key", "at"]].assign(accepted=accepted, oldest=oldest))
            if parts:
                yield pd.concat(parts)

    return walk


def sliding_rate_limit(
    events: DataFrame, key: str, ts: str, row_id: str, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS
) -> DataFrame:
    """E5: every event with ``accepted`` and, when rejected, ``retry_after`` in seconds.

    Events of one instant are taken in ``row_id`` order. Events without a key are one
    key's; one without a time is never accepted.
    """
    # Equal exactly when the keys are, nulls included.
    told = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    window = window_seconds * 1_000_000
    slim = events.select(
        told.alias("key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(row_id).alias("row_id"),
    )
    # Hot keys spread by instant; counts are combined before the shuffle.
    instants = slim.groupBy("key", "at").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.floor(F.col("at") / window))
    slots = instants.groupBy("key", "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("size"))
    order = Window.partitionBy("key").orderBy("slot")
    pause = F.coalesce(F.col("first") - F.lag("last").over(order) >= window, F.lit(True))
    runs = slots.withColumn("run", F.sum(pause.cast("int")).over(order))
    whole = Window.partitionBy("key", "run")
    runs = runs.withColumn("run_size", F.sum("size").over(whole))
    placed = instants.join(runs.select("key", "slot", "run", "run_size"), ["key", "slot"])
    easy = placed.filter(F.col("run_size") <= limit).select(
        "key", "at", F.col("n").alias("accepted"), F.lit(-1).cast("bigint").alias("oldest")
    )
    hard = (
        placed.filter(F.col("run_size") > limit)
        .select("key", F.concat_ws(":", F.col("run").cast("string"), "key").alias("run"), "at", "n")
        .repartition("run")
        .sortWithinPartitions("run", "at")
        .mapInPandas(_walker(limit, window), "key string, at bigint, accepted bigint, oldest bigint")
    )
    verdicts = easy.unionByName(hard)
    # Who was first at a partly accepted instant: at most ``limit`` ids matter.
    first = Window.partitionBy("key", "at").orderBy("row_id")
    places = slim.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
    last_id = (
        places.join(verdicts, ["key", "at"])
        .groupBy("key", "at", "oldest")
        .agg(F.max(F.when(F.col("place") <= F.col("accepted"), F.col("row_id"))).alias("last_id"))
    )
    tagged = events.withColumn("_key", told).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    joined = tagged.join(
        last_id.withColumnsRenamed({"key": "_key", "at": "_at"}), ["_key", "_at"], "left"
    )
    accepted = F.coalesce(F.col(row_id) <= F.col("last_id"), F.lit(False))
    wait = F.ceil((F.col("oldest") + window - F.col("_at")) / 1_000_000)
    return joined.select(
        *events.columns,
        accepted.alias("accepted"),
        F.when(~accepted, F.greatest(F.lit(1).cast("bigint"), wait)).alias("retry_after"),
    )
