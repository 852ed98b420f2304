"""Structured Streaming over events: windows with watermarks, keyed limiters with state, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.sources.files import scratch

#: Events that come later than this are dropped, and state older than this is given up.
LATENESS = "2 days"


def windowed(events: DataFrame, width: str, keys: list[str], slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Counts and sums by event-time window and key."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", width, slide), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def session_counts(events: DataFrame, gap: str, key: str, lateness: str = LATENESS) -> DataFrame:
    """Events by gap session of a key."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), key)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_seen(events: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """Each key once, as long as its repetition is not later than the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def token_bucket(events: DataFrame, key: str, limit: int, width: int, lateness: str = LATENESS) -> DataFrame:
    """(event_id, key, allowed): a bucket of ``limit`` tokens for each key, kept in state between batches.

    A bucket is full again ``width`` seconds after its last request, as a new one is: the watermark then drops its state.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, last = state.get if state.exists else (float(limit), None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed = []
        for at in rows["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            level = min(limit, level + (at - last) * limit / width) if last is not None else level
            allowed.append(level >= 1)
            level, last = (level - 1 if level >= 1 else level), at
        state.update((float(level), float(last)))
        state.setTimeoutTimestamp(max(int((last + width) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"event_id": rows["event_id"], key: k[0], "allowed": allowed})

    kept = events.select("event_id", "ts", key).withWatermark("ts", lateness)
    return kept.groupBy(key).applyInPandasWithState(step, f"event_id long, {key} long, allowed boolean", "level double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(events: DataFrame, kinds: list[str], least: float) -> DataFrame:
    """The events that a listener of these kinds would be called for."""
    return events.where(F.col("event_type").isin(kinds) & (F.col("value") >= least))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything there is and return the result table; restarts go on from the checkpoint.

    Each batch has a folder of its own number, which a repeated batch writes anew; so no row is doubled.
    """
    spark = stream.sparkSession
    out = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-progress")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if mode == "complete" else spark.read.schema(stream.schema).option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def to_folders(stream: DataFrame, path: str, progress: str):
    """Append events to a table partitioned by day, as an audit trail."""
    by_day = stream.withColumn("day", F.to_date("ts"))
    return by_day.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", progress).trigger(availableNow=True).start()
