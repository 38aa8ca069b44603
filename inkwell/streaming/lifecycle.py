"""Streams over artifacts and events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.sources.store import Store


def ingest(stream: DataFrame, path: str, checkpoint: str):
    """Commits each micro-batch's newest version of a key to the store. A micro-batch that is repeated, under the same
    checkpoint, changes nothing: its name is in the store's log."""

    def write(batch: DataFrame, batch_id: int) -> None:
        Store(batch.sparkSession, path).commit(batch, batch=f"{checkpoint}#{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by event time; rows later than the watermark are dropped, as their windows are closed."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), "user_id", "n")


def freshness_changes(stream: DataFrame) -> DataFrame:
    """Emits a key's state whenever it turns fresh, stale_grace or stale_expired, by event-time timers.

    stream: cache_key, at (timestamp, watermarked), fresh_ms, grace_ms.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame()
        if state.hasTimedOut:
            base, fresh, grace, phase = state.get
            name = "stale_grace" if phase == 0 else "stale_expired"
            if phase == 0:
                state.update((base, fresh, grace, 1))
                state.setTimeoutTimestamp(base + fresh + grace + 1)
            else:
                state.remove()
            yield pd.DataFrame({"cache_key": [key[0]], "state": [name]})
            return
        last = rows.sort_values("at").iloc[-1]
        base = int(last["at"].timestamp() * 1000)
        if state.exists and state.get[0] >= base:
            return
        state.update((base, int(last["fresh_ms"]), int(last["grace_ms"]), 0))
        state.setTimeoutTimestamp(base + int(last["fresh_ms"]) + 1)
        yield pd.DataFrame({"cache_key": [key[0]], "state": ["fresh"]})

    return stream.groupBy("cache_key").applyInPandasWithState(
        step, "cache_key string, state string", "base long, fresh long, grace long, phase int", "append", GroupStateTimeout.EventTimeTimeout
    )
