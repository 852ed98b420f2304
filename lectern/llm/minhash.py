"""Near-duplicate detection by circulant MinHash, banding and exact verification.

A shingle is placed at sigma of its 32-bit hash x, the first permutation, and coordinate k of the signature is the smallest
pi(sigma(x) + k * STEP) over a document's shingles: one second permutation, shifted circularly by k. Both are bijective
mixers, so the two permutations need no tables (64-bit shingles are hashed to the 32-bit places first). Bands of coordinates
are the keys of candidate buckets.

Documents with the same shingle set form a class, a node that takes part once; classes have numbers of their own, so rows
that share a doc_id stay apart. A bucket may hold any
number of classes, so its pairs are never listed outright. In a first round each class is checked against one leader,
the one that leads most of its buckets; components of the confirmed links then show which buckets still hold more than
one component, and only pairs across components of one bucket go on: against leaders in another order, and at last all
that are left, so that no candidate is dropped. Before texts are fetched, a pair must pass the size bound and an
estimate from the signatures (a link at the threshold fails it about once in 10**8); links are confirmed on the full
shingle sets (64-bit hashes).

With 48 bands of 5 coordinates a link at the threshold of 0.75 meets in no band about twice in a million.

Defined cases: documents without words have an empty set and are linked with nothing; fewer than five words are one
shingle; null texts are empty; very long texts are read whole; rows with a null doc_id take part, and a component of such
rows only has a null id; repeated rows are in the same component as each other; rows of one doc_id with different texts are
linked by their texts alone; an empty table gives an empty result; further columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``, which keeps one row of each component: the smallest doc_id, nulls
last, and of rows with that id and equal text one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import boxed, join_by_key, materialize, slices, texts
from lectern.llm.components import components
from lectern.llm.textops import distinct_per_doc, lower_ascii, mix, prefix_sums, runs, shingles, span_hash, views

WORDS, PERCENT = 5, 75
BANDS, ROWS = 48, 5
#: An odd number: the distance that one circular shift moves.
STEP = np.uint32(0x9E3779B1)
#: Rounds against leaders before the prefix filter.
LEADER_ROUNDS = 3
#: How many of the most frequent shingles are told apart by the order of the prefix filter; it only saves work.
COMMON = 100_000
#: Pairs that one copy of a leader's text serves at most.
SALT_PAIRS = 256


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, by document and value."""
    raw, off = views(col)
    raw = lower_ascii(raw)
    starts, ends, docs = runs((raw != 32) & ((raw < 9) | (raw > 13)), off)
    h, d = shingles(span_hash(prefix_sums(raw), starts, ends), docs, WORDS, len(col))
    return distinct_per_doc(h, d)


def permuted(y: np.ndarray, k: int) -> np.ndarray:
    """pi of the places shifted by k: a bijection of 32-bit numbers."""
    z = y + np.uint32(k * int(STEP) % 2**32)
    z ^= z >> np.uint32(16)
    z *= np.uint32(0x85EBCA6B)
    z ^= z >> np.uint32(13)
    z *= np.uint32(0xC2B2AE35)
    z ^= z >> np.uint32(16)
    return z


def signatures(values: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """coordinates x documents, for sets that start at ``begin`` (none empty)."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    y = permuted(x * np.uint32(0x2C1B3C6D) ^ np.uint32(0xA5A5A5A5), 0)  # sigma, a bijection of 32-bit numbers
    return np.stack([np.minimum.reduceat(permuted(y, k), begin) for k in range(coordinates)])


def hashed(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, ..) with ``row_hash`` of both: it tells rows apart that differ (64 bits, as for shingles)."""
    return docs.withColumn("row_hash", F.xxhash64("doc_id", "text"))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, n_shingles, set_key, sig, bands); set_key and the others are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, owner = shingle_sets(part.column("text"))
            n = np.bincount(owner, minlength=part.num_rows) if len(owner) else np.zeros(part.num_rows, np.int64)
            full = np.flatnonzero(n)
            keys: list = [None] * part.num_rows
            sigs: list = [None] * part.num_rows
            bands: list = [None] * part.num_rows
            if len(full):
                begin = (np.cumsum(n) - n)[full]
                sums = np.stack([np.add.reduceat(mix(values), begin), np.add.reduceat(mix(values ^ np.uint64(0x5BD1E995)), begin), n[full].astype(np.uint64)], 1)
                sig = signatures(values, begin, BANDS * ROWS)
                short = np.ascontiguousarray(sig.astype(np.uint8).T)
                h = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    h = mix(h ^ sig[r::ROWS].astype(np.uint64))
                h = np.ascontiguousarray(h.T).view(np.int64)
                for i, d in enumerate(full.tolist()):
                    keys[d], sigs[d], bands[d] = sums[i].tobytes(), short[i].tobytes(), h[i]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "row_hash", "n_shingles", "set_key", "sig", "bands"])

    return hashed(texts(docs)).mapInArrow(run, "doc_id long, row_hash long, n_shingles long, set_key binary, sig binary, bands array<long>")


def salted(pairs: DataFrame) -> DataFrame:
    """(a, salt, b): a leader ``a`` of any number of pairs is dealt as one copy for SALT_PAIRS of them."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias("salts"))
    return pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, salt, b) whose sizes and signatures allow a link."""
    size = BANDS * ROWS
    p = PERCENT / 100
    least = int(size * (p - 5.6 * (p * (1 - p) / size) ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, size) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "salt", "b"]).filter(pa.array((x == y).sum(1) >= least))

    one = lambda s: classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT
    leaders = pairs.select("a", "salt").distinct().join(one("a"), "a")
    both = pairs.join(one("b"), "b").join(leaders, ["a", "salt"])
    return both.where(fit).select("a", "salt", "b", "sig_a", "sig_b").mapInArrow(run, "a long, salt int, b long")


def confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, salt, b) whose full shingle sets are similar enough; ``held`` has node and text of all classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column="text_b"):
            (va, da), (vb, db) = shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b"))
            v, d = np.concatenate([va, vb]), np.concatenate([da, db])
            order = np.lexsort((v, d))
            v, d = v[order], d[order]
            same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
            both = np.bincount(d[1:][same], minlength=part.num_rows)
            union = np.bincount(d, minlength=part.num_rows) - both
            yield part.select(["a", "b"]).filter(pa.array((100 * both >= PERCENT * union) & (both > 0)))

    leaders = pairs.select("a", "salt").distinct()
    left = held.join(pairs, held["node"] == pairs["b"]).select("a", "salt", "b", F.col("text").alias("text_b"))
    right = held.join(leaders, held["node"] == leaders["a"]).select("a", "salt", F.col("text").alias("text_a"))
    return left.join(right, ["a", "salt"]).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def prefix_pairs(open_docs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) across the components of ``open_docs`` (rep, component) that share a shingle of their prefixes."""
    spark = held.sparkSession
    rows = materialize(held.join(open_docs, held["node"] == open_docs["rep"]).select("rep", "component", "text"), "open-texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, n = np.unique(shingle_sets(part.column("text"))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    frequent = rows.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 2")
    top = [r["shingle"] for r in frequent.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()]
    common = np.array(top, np.int64).view(np.uint64)
    order = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[order], len(common) - order))  # a later place for what is more frequent

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, late = shared.value
        for part in slices(batches):
            values, owner = shingle_sets(part.column("text"))
            place = np.zeros(len(values), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, values), len(names) - 1)
                place = np.where(names[at] == values, late[at], 0)
            sort = np.lexsort((values, place, owner))
            n = np.bincount(owner, minlength=part.num_rows) if len(owner) else np.zeros(part.num_rows, np.int64)
            number = np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
            keep = number < np.repeat(n - -(-n * PERCENT // 100) + 1, n)
            who = pa.array(owner[sort][keep])
            yield pa.RecordBatch.from_arrays([pa.array(values[sort][keep].view(np.int64)), part.column("rep").take(who), part.column("component").take(who), pa.array(np.repeat(n, n)[keep], pa.int64()), pa.array(number[keep], pa.int64())], ["shingle", "rep", "component", "n", "place"])

    keys = materialize(rows.mapInArrow(prefixes, "shingle long, rep long, component long, n long, place long"), "prefixes")
    other = keys.select("shingle", F.col("rep").alias("b"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("place").alias("other_place"))
    # from the first shingle that both have on, they share at most what is left of either; a link needs p / (1 + p) of both sizes
    left = F.least(F.col("n") - F.col("place"), F.col("m") - F.col("other_place"))
    fit = (F.least("n", "m") * 100 >= F.greatest("n", "m") * PERCENT) & (left * (100 + PERCENT) >= (F.col("n") + F.col("m")) * PERCENT)
    return keys.join(other, "shingle").where((F.col("rep") < F.col("b")) & (F.col("component") != F.col("c")) & fit).select(F.col("rep").alias("a"), "b").distinct()


def links_of(docs: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(node, component) over all classes that are linked with another one.

    ``classes`` has node (the row_hash of one of its rows), bands and sig; ``repeated`` the row_hash that several rows have.
    """
    spark = docs.sparkSession
    banded = classes.select(F.col("node").alias("rep"), F.explode("bands").alias("key"))
    by_key = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    shared = materialize(by_key.where("n > 1"), "shared-keys")
    members = materialize(banded.join(shared, "key").select("key", "rep"), "members")
    wanted = materialize(members.select(F.col("rep").alias("node")).distinct(), "wanted")
    rows = hashed(texts(docs)).select(F.col("row_hash").alias("node"), "text")
    # texts meet by sort and merge at every size: the list of wanted ones grows with the input. They lie by node then, as the table does.
    once = rows.join(wanted.join(repeated.withColumnRenamed("row_hash", "node"), "node", "left_anti").hint("merge"), "node")
    often = rows.join(wanted.join(repeated.withColumnRenamed("row_hash", "node"), "node", "left_semi"), "node").groupBy("node").agg(F.first("text").alias("text"))
    table = f"candidate_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.unionByName(often).write.format("parquet").option("compression", "zstd").bucketBy(buckets, "node").sortBy("node").saveAsTable(table)
    held = spark.table(table)
    tried = found = nodes = None
    for number in range(LEADER_ROUNDS + 1):
        labelled = members.withColumn("component", F.col("rep"))
        if nodes is not None:
            labelled = members.join(nodes, members["rep"] == nodes["node"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        first = F.min(F.struct(F.xxhash64("rep", F.lit(number)).alias("o"), F.col("rep").alias("a"), F.col("component").alias("c")))
        keyed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), first.alias("lead")).where("x <> y").select("key", "lead")
        # a bucket that still holds several components is open; one that is as hot as its group is large is split by the adaptive skew join
        open_ = materialize(labelled.select("key", "rep", "component").join(keyed, "key"), "open-members")
        if open_.isEmpty():
            break
        if number < LEADER_ROUNDS:
            led = open_.where("lead.c <> component").select(F.col("lead.a").alias("a"), F.col("rep").alias("b"))
            votes = led.groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
            pairs = votes.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select("best.a", "b") if number == 0 else votes.select("a", "b")
        else:
            pairs = prefix_pairs(open_.select("rep", "component").distinct(), held)
        if tried is not None:
            done = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        new = materialize(confirmed(materialize(likely(salted(pairs), classes), "likely"), held), "confirmed")
        tried = pairs if tried is None else tried.union(pairs)
        found = new if found is None else found.union(new)
        nodes = components(found)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return classes.select("node").limit(0).withColumn("component", F.col("node")) if nodes is None else nodes


def resolved(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches; for each class its set_key, copies, node, doc_id (of its first row) and component with that one's first row
    (component_doc, component_node); and the row_hash that several rows have."""
    seen = materialize(sketches(docs), "sketches")
    repeated = materialize(seen.groupBy("row_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_hash"), "repeated-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash"))
    classes = seen.where("n_shingles > 0").groupBy("set_key").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = materialize(classes.select("set_key", "copies", "n_shingles", "sig", "bands", "first.doc_id", F.col("first.row_hash").alias("node")), "classes")
    nodes = links_of(docs, classes, repeated)
    labelled = materialize(classes.select("set_key", "copies", "node", "doc_id").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled-classes")
    heads = labelled.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"))
    heads = heads.select("component", F.col("head.doc_id").alias("component_doc"), F.col("head.node").alias("component_node"))
    return seen, labelled.join(heads, "component"), repeated


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    seen, classes, _ = resolved(docs)
    alone = seen.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    full = seen.where("n_shingles > 0").select("doc_id", "n_shingles", "set_key")
    out = join_by_key(full, classes.select("set_key", "copies", "component_doc"), "set_key", "copies", seen.count()).select("doc_id", "n_shingles", F.col("component_doc").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns, and every row without words."""
    seen, classes, repeated = resolved(docs)
    heads = materialize(classes.where("node = component_node").select(F.col("node").alias("row_hash")), "kept-rows")
    wordless = seen.where("n_shingles = 0").select("row_hash").distinct()
    rows = hashed(boxed(docs))
    once = rows.join(heads.join(repeated, "row_hash", "left_anti").unionByName(wordless).hint("merge"), "row_hash", "left_semi").select("row")
    often = rows.join(heads.join(repeated, "row_hash", "left_semi"), "row_hash", "left_semi").groupBy("row_hash").agg(F.first("row").alias("row")).select("row")
    return once.unionByName(often).select("row.*")
