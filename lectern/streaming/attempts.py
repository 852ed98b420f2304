"""Failed attempts by account, in event-time order, with timers: state that is put in order, judged and dropped.

Rows of a batch come in any order. Each waits in the state until the watermark has passed it: a timer at the earliest one then
judges all that the watermark has passed, in order, so the rows that wait are read once for each step of the watermark. A second timer, RESET after the last failure,
drops the account's counters; accounts that are quiet hold no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ALERT = "account long, ts timestamp, attempts int"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(ts) -> int:
    """A timestamp of the session's zone UTC as microseconds."""
    return pd.Timestamp(ts).value // 1000


class Attempts(StatefulProcessor):
    """An alert at each ``most``-th failure of an account since it was last quiet for ``reset`` seconds."""

    def __init__(self, most: int, reset: int):
        self.most, self.reset = most, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long", "n int")
        self.counted = handle.getValueState("counted", "last_us long, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for us, n in frame["ts"].map(micros).value_counts().items():
                before = self.waiting.getValue((int(us),)) if self.waiting.containsKey((int(us),)) else (0,)
                self.waiting.updateValue((int(us),), (before[0] + int(n),))
            if len(frame):
                self.handle.registerTimer(int(frame["ts"].map(micros).min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        due = [x for x in waiting if x[0] < upto]
        if len(due) < len(waiting):
            self.handle.registerTimer(waiting[len(due)][0] // 1000 + 1)
        last, attempts = self.counted.get() if self.counted.exists() else (0, 0)
        alerts = []
        for us, n in due:
            self.waiting.removeKey((us,))
            for _ in range(n):
                attempts = attempts + 1 if last and us - last <= self.reset * 1_000_000 else 1
                last = us
                if attempts % self.most == 0:
                    alerts.append((key[0], EPOCH + timedelta(microseconds=us), attempts))
        if due:
            self.counted.update((last, attempts))
            self.handle.registerTimer(last // 1000 + self.reset * 1000 + 2)
        elif last and last + self.reset * 1_000_000 < upto:
            self.counted.clear()
        if alerts:
            frame = pd.DataFrame(alerts, columns=["account", "ts", "attempts"])
            yield frame.assign(ts=frame["ts"].dt.tz_convert(None))

    def close(self) -> None:
        pass


def repeated_failures(events: DataFrame, account: str, most: int, reset: int, late: str = "0 seconds") -> DataFrame:
    """Alerts (account, ts, attempts) of a stream of failures with a timestamp ``ts``."""
    rows = events.select(F.col(account).cast("long").alias("account"), "ts").where("account IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("account").transformWithStateInPandas(Attempts(most, reset), ALERT, outputMode="Append", timeMode="EventTime")


def repeated_failures_batch(events: DataFrame, account: str, most: int, reset: int) -> DataFrame:
    """The same alerts of a table, by windows."""
    rows = events.select(F.col(account).cast("long").alias("account"), "ts").where("account IS NOT NULL AND ts IS NOT NULL")
    order = Window.partitionBy("account").orderBy("ts")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) <= reset * 1_000_000
    runs = rows.withColumn("run", F.sum(F.when(gap, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = runs.withColumn("attempts", F.row_number().over(Window.partitionBy("account", "run").orderBy("ts")))
    return counted.where(F.col("attempts") % most == 0).select("account", "ts", "attempts")
