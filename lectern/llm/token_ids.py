"""Token-ID output: one concatenated id array a block, with Elias-Fano encoded document boundaries.

A block is self-contained: the header (magic, width, n_docs, n_ids, the first doc_id, and how many ids of its shard stand
before it), which doc_ids are null, the doc_ids (they rise, so they are Elias-Fano coded as well), the boundaries and the
ids; there are no 64-bit tables. A reader gets each document's offsets by ``select``. The boundaries are a non-decreasing sequence of n_docs + 1 numbers up
to n_ids; each is split into ``low_bits`` low bits, packed one after another, and a unary coded high part, so that they
take about 2 + log2(n_ids / n_docs) bits each instead of 64. ``EliasFano.get`` selects the i-th one bit through samples
taken every 256 ones, so an offset is found without unpacking the rest.

Documents are dealt by ranges of doc_id and sorted, so shard numbers and block numbers give the order of the whole
corpus. Blocks are stored as rows of a Parquet table: Spark's commit protocol makes each shard appear once even if
tasks are repeated, and any store that Spark reaches will do.

Defined cases: a null text is an empty one (the end id alone); a very long text is one document of one block; null doc_ids
come first; repeated rows are documents of their own, next to each other, ties in doc_id by text; an empty table gives an
empty output; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import scratch_path, texts
from lectern.llm.wordcache import encoded

MAGIC = b"LTI2"
HEADER = "<4sBxxxIqQQ"
#: Distance of the select samples, in ones.
SAMPLE = 256
BLOCKS = "shard int, block int, n_docs long, n_ids long, payload binary"


class EliasFano:
    """A non-decreasing sequence of whole numbers in near-minimal space, with select access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ones: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, int(universe // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        unary = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
        unary[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low_bits, low, np.packbits(unary, bitorder="little"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBII", data, at)
        at += struct.calcsize("<QBII")
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)), at + a + b

    def _samples(self) -> np.ndarray:
        if self._ones is None:  # the ones before each byte, thinned to one sample for SAMPLE ones
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high).astype(np.int64))])
            self._ones = np.stack([np.searchsorted(before, np.arange(0, max(1, self.n), SAMPLE), "right") - 1, before[np.searchsorted(before, np.arange(0, max(1, self.n), SAMPLE), "right") - 1]])
        return self._ones

    def get(self, i: int) -> int:
        byte, ones = (int(x) for x in self._samples()[:, i // SAMPLE])
        while ones + (c := int(self.high[byte]).bit_count()) <= i:
            byte, ones = byte + 1, ones + c
        bits = int(self.high[byte])
        for _ in range(i - ones):
            bits &= bits - 1
        value = 8 * byte + (bits & -bits).bit_length() - 1 - i
        low = 0
        for k in range(self.low_bits):
            p = i * self.low_bits + k
            low |= (int(self.low[p >> 3]) >> (p & 7) & 1) << k
        return value << self.low_bits | low

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out


def write_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """``doc_ids`` must not fall, other than nulls; ``counts`` are the ids of each document in ``ids``."""
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    none = np.array([d is None for d in doc_ids], np.uint8)
    named = [d for d in doc_ids if d is not None]
    first = named[0] if named else 0
    steps = EliasFano.encode(np.array([d - first for d in named], np.uint64), named[-1] - first if named else 0)
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(counts)]), int(counts.sum()))
    head = struct.pack(HEADER, MAGIC, wide, len(doc_ids), first, len(ids), before)
    return head + np.packbits(none).tobytes() + steps.to_bytes() + bounds.to_bytes() + ids.astype(f"<u{wide}").tobytes()


class Block:
    """A block as it was read: ``doc_ids``, ``bounds`` (Elias-Fano) and ``ids``."""

    def __init__(self, data: bytes):
        magic, wide, self.n_docs, first, n_ids, self.before = struct.unpack_from(HEADER, data, 0)
        if magic != MAGIC:
            raise ValueError("not a token-id block")
        at = struct.calcsize(HEADER)
        none = np.unpackbits(np.frombuffer(data, np.uint8, -(-self.n_docs // 8), at))[: self.n_docs].astype(bool)
        steps, at = EliasFano.from_bytes(data, at + -(-self.n_docs // 8))
        named = iter(steps.decode().tolist())
        self.doc_ids = [None if a else first + next(named) for a in none.tolist()]
        self.bounds, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{wide}", n_ids, at)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, offset, ids) of each document, its offsets selected one by one."""
        end = self.bounds.get(0)
        for i, doc_id in enumerate(self.doc_ids):
            start, end = end, self.bounds.get(i + 1)
            yield doc_id, start, self.ids[start:end]

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]


def write_token_ids(docs: DataFrame, out: str, path: str | None = None, end_id: int = 1) -> None:
    """Encode all texts, end each with ``end_id`` and write them as blocks below ``out``, in ascending doc_id order."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for number, (part, ids, counts) in enumerate(encoded(batches, path)):
            ends = np.cumsum(counts)
            full = np.insert(ids, ends, end_id)
            payload = write_block(part.column("doc_id").to_pylist(), counts + 1, full, before)
            before += len(full)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([part.column("shard")[0].as_py()], pa.int32()), "block": pa.array([number], pa.int32()), "n_docs": pa.array([len(counts)], pa.int64()), "n_ids": pa.array([len(full)], pa.int64()), "payload": pa.array([payload], pa.binary())})

    dealt.mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(out)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: those of earlier shards (one number for each shard, summed on
    the driver; there are as many shards as range partitions, not more for more rows of one) and those before it in its own.
    """
    table = spark.read.schema(BLOCKS).parquet(path)
    totals = {int(r["shard"]): int(r["n"]) for r in table.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    first, at = {}, 0
    for shard in sorted(totals):
        first[shard], at = at, at + totals[shard]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_buffer().to_pybytes())
                before = first[shard] + block.before
                rows = [(doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4"))) for doc_id, start, ids in block.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("shard", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, out: str | None = None, path: str | None = None, end_id: int = 1) -> DataFrame:
    out = out or scratch_path(docs.sparkSession, "token-ids")
    write_token_ids(docs, out, path, end_id)
    return read_token_ids(docs.sparkSession, out)
