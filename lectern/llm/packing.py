"""Best-fit packing of tokenised documents into sequences of a fixed capacity, in bulk-synchronous rounds.

Pieces are sorted by length, longest first, and open sequences by the gap they have left. A round takes all pieces of
one length, sweeps to the successor gap (the smallest one that still fits), matches the k-th piece of that length with
the k-th sequence of that gap, updates the gaps and repeats until the pieces are placed; pieces that no gap takes open
new sequences. As lengths and gaps are whole numbers up to the capacity, a round needs only how many pieces and gaps
each class has: the sweep runs over at most ``capacity`` classes, whatever the number of documents, and yields ranges
"pieces r0..r1 of length L go to sequences s0..s1 at offset o". Conflicts within a class are resolved by rank. Ranks
come from a distributed sort: rows are dealt by (length, block), numbered within the block, and shifted by the sizes of
the blocks before it.

Defined cases: a null text is an empty one, so it is one piece, the end id alone; very long texts are cut into pieces of the
capacity; pieces of one length are ranked by id, piece and content, so rows that tie in all of these are the same; null
doc_ids are packed like others; repeated rows are pieces of their own; an empty table gives an empty result; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize, texts
from lectern.llm.wordcache import encoded

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut only beyond the capacity."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, counts in encoded(batches, path):
            rows: list[list] = [[], [], [], [], []]
            at, little = 0, ids.astype("<u4")
            end = np.array([end_id], "<u4").tobytes()
            for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                data = little[at : at + n].tobytes() + end
                for k in range(-(-(n + 1) // capacity)):
                    piece = data[4 * k * capacity : 4 * (k + 1) * capacity]
                    for column, x in zip(rows, (doc_id, k, k * capacity, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        column.append(x)
                at += n
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rounds of successor sweeps over classes: (length, first rank, end rank, first sequence, offset) ranges."""
    out: list[tuple[int, int, int, int, int]] = []
    open_at: dict[int, list[tuple[int, int]]] = {}  # gap: ranges of sequences that have it
    gaps = np.zeros(capacity + 1, bool)
    fresh = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap:
            open_at.setdefault(gap, []).append((first, n))
            gaps[gap] = True

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = np.flatnonzero(gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, n = open_at[gap].pop()
                if not open_at[gap]:
                    gaps[gap] = False
                take = min(n, left)
                if take < n:
                    put(gap, first + take, n - take)
            else:
                gap, first = capacity, fresh
                take = -(-left // (capacity // length))
                fresh += take
            out.append((length, rank, rank + take, first, capacity - gap))
            put(gap - length, first, take)
            rank, left = rank + take, left - take
    return out


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``: their number, from 0, among all of the same length."""
    blocks = max(1, math.isqrt(items.count()))  # then neither a block's rows nor a length's blocks grow faster than the root
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    sizes = dealt.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "block").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in items.columns])
    numbered = dealt.withColumn("within", F.row_number().over(within) - 1)
    return numbered.join(shifts, ["length", "block"]).withColumn("rank", F.col("shift") + F.col("within")).drop("block", "shift", "within")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece, length, ..) with sequence_id and offset.

    Lengths must lie between 1 and the capacity. The class counts (at most ``capacity`` rows) and the plan's ranges,
    whose number depends on the capacity and not on the rows, are all that the driver holds.
    """
    spark = items.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = plan(counts, capacity)
    by_length: dict[int, tuple[list, list, list]] = {}
    for length, r0, _, s0, offset in ranges:
        row = by_length.setdefault(length, ([], [], []))
        for column, x in zip(row, (r0, s0, offset), strict=True):
            column.append(x)
    table = spark.sparkContext.broadcast({k: tuple(np.array(x, np.int64) for x in v) for k, v in by_length.items()})
    todo = ranked(items)
    out = todo.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths):
                r0, s0, o = table.value[int(length)]
                mine = np.flatnonzero(lengths == length)
                at = np.searchsorted(r0, ranks[mine], "right") - 1
                sequence[mine], offset[mine] = s0[at] + ranks[mine] - r0[at], o[at]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return todo.mapInArrow(place, out)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    items = materialize(pieces(docs, path or public_tokenizers.path("word_bpe_49k.json"), end_id, capacity), "pieces")
    return pack(items, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
