"""Streams with timers and the deck writer, against the batch and plain Python."""

import glob
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.sources import decks
from lectern.streaming.attempts import repeated_failures, repeated_failures_batch

START = datetime(2024, 1, 1)


def failures(seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), START + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(3) * 250_000)) for _ in range(500)]
    rows += [(1, START + timedelta(seconds=7))] * 4 + [(None, START), (2, None)]
    return rows


def plain(rows, most, reset):
    out, last, count = [], {}, {}
    for account, ts in sorted((r for r in rows if None not in r), key=lambda r: (r[0], r[1])):
        count[account] = count.get(account, 0) + 1 if account in last and ts - last[account] <= timedelta(seconds=reset) else 1
        last[account] = ts
        if count[account] % most == 0:
            out.append((account, ts, count[account]))
    return sorted(out)


def test_batch_of_failures(spark):
    rows = failures()
    df = spark.createDataFrame(rows, "user long, ts timestamp")
    got = sorted(tuple(r) for r in repeated_failures_batch(df, "user", 3, 600).collect())
    assert got == plain(rows, 3, 600) and len(got) > 20


def test_stream_of_failures_is_the_batch(spark, tmp_path):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = failures()
        by_time = sorted((r for r in rows if r[1]), key=lambda r: r[1])
        folder, parts = tmp_path / "in", 4
        for k in range(parts):  # in each batch rows are out of order
            part = by_time[k * len(by_time) // parts : (k + 1) * len(by_time) // parts]
            random.Random(k).shuffle(part)
            spark.createDataFrame(part, "user long, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
            last = max(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime)
            os.utime(last, (1_700_000_000 + k, 1_700_000_000 + k))
        end = START + timedelta(days=3)  # moves the watermark past all that came before, and past the last reset
        for k in (parts, parts + 1):
            spark.createDataFrame([(99, end + timedelta(seconds=k))], "user long, ts timestamp").coalesce(1).write.mode("append").parquet(str(folder))
            os.utime(max(glob.glob(f"{folder}/*.parquet"), key=os.path.getmtime), (1_700_000_000 + k, 1_700_000_000 + k))
        stream = spark.readStream.schema("user long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
        alerts = repeated_failures(stream, "user", 3, 600)
        query = alerts.writeStream.format("memory").queryName("failures").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert sorted(tuple(r) for r in spark.table("failures").collect()) == plain(rows, 3, 600)
        counted = spark.read.format("statestore").option("stateVarName", "counted").load(str(tmp_path / "state"))
        assert counted.where("key.account < 99").count() == 0  # timers have dropped the counters of quiet accounts
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


SLIDES = [(1, 0, "Intro", "a\nb"), (1, 1, None, "<!-- slide {} -->\n---\n"), (-2, 0, "é \U0001f600", ""), (None, -5, "x", None), (None, None, None, "--> -- -"), (3, None, "-->  ", "\r\n end")]


@pytest.fixture(scope="module")
def slides(spark):
    spark.dataSource.register(decks.DeckSource)
    return spark.createDataFrame(SLIDES, decks.SCHEMA)


def read(spark, folder):
    return sorted((tuple(r) for r in spark.read.format("decks").option("path", folder).load().collect()), key=repr)


def test_decks_round_trip(spark, slides, tmp_path):
    folder = str(tmp_path / "decks")
    slides.repartition(2, "deck").write.format("decks").option("path", folder).mode("append").save()
    assert read(spark, folder) == sorted(SLIDES, key=repr)
    listed = json.load(open(f"{folder}/_SUCCESS"))
    assert listed["rows"] == len(SLIDES) and sorted(x for x in os.listdir(folder) if x != "_SUCCESS") == listed["files"]
    slides.limit(2).write.format("decks").option("path", folder).mode("append").save()
    assert len(read(spark, folder)) == len(SLIDES) + 2
    slides.where("deck = 1").write.format("decks").option("path", folder).mode("overwrite").save()
    assert read(spark, folder) == sorted((x for x in SLIDES if x[0] == 1), key=repr)


def test_aborted_job_leaves_nothing(spark, slides, tmp_path):
    folder = str(tmp_path / "aborted")
    slides.where("deck = 1").write.format("decks").option("path", folder).mode("append").save()
    before = sorted(os.listdir(folder))
    bad = slides.withColumn("ordinal", F.when(F.col("deck") == 3, F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("ordinal")))
    with pytest.raises(Exception, match="no"):
        bad.repartition(3).write.format("decks").option("path", folder).mode("overwrite").save()
    assert sorted(os.listdir(folder)) == before and len(read(spark, folder)) == 2
