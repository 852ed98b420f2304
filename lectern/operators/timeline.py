"""Operators on event time: calendar and tumbling counters, gap sessions, limiters, lockouts and running profiles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Minutes of the n-th lockout; the last one holds for all further ones.
LOCKOUT_MINUTES = [5, 15, 30, 60, 120, 360, 720, 1440]


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_timestamp(ts.cast("timestamp"))


def window_start(ts: Column, width: int) -> Column:
    return seconds(ts) - seconds(ts) % width


def fixed_window(df: DataFrame, key: str, ts: str, order: list[str], limit: int, width: int) -> DataFrame:
    """Adds window_start, the request's number in it and whether it is allowed."""
    start = window_start(F.col(ts), width)
    w = Window.partitionBy(key, "window_start").orderBy(*order)
    return df.withColumn("window_start", start).withColumn("number", F.row_number().over(w).cast("long")).withColumn("allowed", F.col("number") <= limit)


def sessions(df: DataFrame, key: str, ts: str, order: list[str], gap: int) -> DataFrame:
    """Adds ``session``: how many gaps of more than ``gap`` seconds came before (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(*order)
    at = seconds(F.col(ts))
    new = F.when(at - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


def lockouts(attempts: DataFrame, key: str, ts: str, order: list[str], gap: int = 3600, most: int = 5) -> DataFrame:
    """Every ``most``-th attempt of a session locks the key; the n-th lockout of a key lasts as the table says."""
    numbered = sessions(attempts, key, ts, order, gap).withColumn("number", F.row_number().over(Window.partitionBy(key, "session").orderBy(*order)))
    locked = numbered.where(F.col("number") % most == 0).withColumn("lockout", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    minutes = F.array(*map(F.lit, LOCKOUT_MINUTES))
    return locked.withColumn("minutes", F.element_at(minutes, F.least(F.col("lockout"), F.lit(len(LOCKOUT_MINUTES))).cast("int")).cast("long")).drop("number")


def _fold(df: DataFrame, key: str, ts: str, order: list[str], step, state) -> DataFrame:
    """A sequential decision for each row of a key, in order: the rows of a key are read as a stream of sorted batches.

    Keys are dealt by hash and sorted in their partition, so no key has to fit into memory.
    """
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("allowed", BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = object(), None
        for batch in batches:
            out = []
            for k, at in zip(batch[key], batch["_at"], strict=True):
                if k != current:
                    current, held = k, state()
                out.append(step(held, at))
            yield batch[names].assign(allowed=out)

    dealt = df.withColumn("_at", F.col(ts).cast("timestamp").cast("double")).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, schema)


def sliding_window(df: DataFrame, key: str, ts: str, order: list[str], limit: int, width: int) -> DataFrame:
    """Allowed if fewer than ``limit`` accepted requests lie in the last ``width`` seconds; rejected ones don't count."""

    def step(accepted: list[float], at: float) -> bool:
        while accepted and accepted[0] <= at - width:
            accepted.pop(0)
        if len(accepted) >= limit:
            return False
        accepted.append(at)
        return True

    return _fold(df, key, ts, order, step, list)


def token_bucket(df: DataFrame, key: str, ts: str, order: list[str], limit: int, width: int) -> DataFrame:
    """A bucket of ``limit`` tokens, refilled over ``width`` seconds; each accepted request takes one."""

    def step(bucket: dict, at: float) -> bool:
        level = min(limit, bucket.get("level", limit) + (at - bucket.get("at", at)) * limit / width)
        bucket.update(at=at, level=level - 1 if level >= 1 else level)
        return level >= 1

    return _fold(df, key, ts, order, step, dict)


def rate_gate(df: DataFrame, key: str, ts: str, order: list[str], per_second: float) -> DataFrame:
    """Accepted if at least 1 / per_second seconds passed since the last accepted update."""

    def step(last: list[float], at: float) -> bool:
        if last and at - last[0] < 1 / per_second:
            return False
        last[:] = [at]
        return True

    return _fold(df, key, ts, order, step, list)


def moving_average(values: Column, alpha: float) -> Column:
    """Exponential moving average of an ordered array; its first value is the start."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)).cast("double"), lambda a, x: (1 - alpha) * a + alpha * x)


def retry_delay(attempt: Column, base: int, most: int = 300) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt))


def day_keys(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first.cast("date"), last.cast("date"), F.expr("interval 1 day")))


def packed(df: DataFrame, key: str, order: list[str], size: str, most: int, capacity: int) -> DataFrame:
    """Adds ``batch``: rows of a key, in order, fill a batch until it has ``most`` rows or the next would exceed the capacity."""
    names = df.columns
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number, rows, held = object(), 0, 0, 0
        for batch in batches:
            out = []
            for k, n in zip(batch[key], batch[size], strict=True):
                if k != current:
                    current, number, rows, held = k, 0, 0, 0
                elif rows == most or held + n > capacity:
                    number, rows, held = number + 1, 0, 0
                rows, held = rows + 1, held + n
                out.append(number)
            yield batch[names].assign(batch=out)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
