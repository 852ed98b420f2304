"""Helpers that several operators share: scratch tables, text slices and hot-key joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one step of a vectorised scan holds at a time, in bytes (a longer document is one slice of its own).
SLICE_BYTES = 1 << 20
#: A key is hot if it holds more than one part in this many of all rows; so there are fewer hot keys than this.
HOT_PARTS = 1000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share: ``spark.checkpoint.dir``, or on one machine the warehouse if none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def boxed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each row as one struct beside its id and text, so that helper columns clash with none of its names.

    ``select("row.*")`` gives the columns of ``docs`` back.
    """
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text only; a null text is an empty one, further columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each part has at most ``most`` bytes, or is one row."""
    for batch in batches:
        col = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(lengths):
            yield batch.slice(start)


def hot_threshold(rows: int, parts: int = HOT_PARTS) -> int:
    """Keys with more rows than this are hot; there are at most ``parts`` of them, however large the table is."""
    return max(1, rows // parts)


def join_by_key(left: DataFrame, right: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """Left join of many rows to one row for each key, where a few keys may hold most rows of ``left``.

    ``right`` has how many rows of ``left`` its key has, in ``count``. Hot keys (fewer than HOT_PARTS of them, since
    together they can't have more than all rows) are broadcast, so their rows stay where they are; the rest is joined
    by a shuffle in which no key is large.
    """
    most = hot_threshold(rows)
    hot = right.where(F.col(count) > most)
    names = [c for c in right.columns if c != key]
    tagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    near = tagged.where(F.col("_hot")).drop("_hot")
    rest = tagged.where(F.col("_hot").isNull()).drop("_hot", *names).join(right.where(F.col(count) <= most), key, "left")
    return near.unionByName(rest.select(near.columns))
