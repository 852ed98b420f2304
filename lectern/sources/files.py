"""Reading and writing files with declared schemas, through Spark's own sources only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Audit events as newline-delimited JSON.
AUDIT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, level string, outcome string, value double, details map<string,string>"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or on one machine the warehouse if the session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def audit_log(spark: SparkSession, path: str, **wanted) -> DataFrame:
    """Audit events from JSON lines: broken lines are dropped; filters are applied before any offset."""
    from lectern.operators.relational import matching

    return matching(spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path), **wanted)


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON documents, one for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_at_once: int = 16) -> DataFrame:
    """The events table as a stream, with event time as a timestamp (sessions run in UTC)."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """One table as JSON lines, CSV with a header, Parquet or ORC."""
    writer = df.write.mode("errorifexists")
    {"json": writer.json, "csv": lambda p: writer.option("header", True).csv(p), "parquet": writer.parquet, "orc": writer.orc}[kind](path)


def export_many(df: DataFrame, path: str, kinds: list[str]) -> None:
    """Several formats of one result, which is computed once."""
    held = df.persist()
    try:
        for kind in kinds:
            export(held, f"{path}/{kind}", kind)
    finally:
        held.unpersist()
