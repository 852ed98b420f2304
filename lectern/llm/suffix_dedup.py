"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed if a string of SPAN bytes covers it that also starts in a document with a smaller doc_id.

Parsing: a rolling hash runs over all strings of GRAM bytes, and the smallest hash in each window of SPAN bytes is its
trigger. Which trigger a window has depends on its own bytes alone, so equal windows have equal triggers at equal
places, and there is one in every window. Each trigger closes a phrase: the windows that have it, whose bytes overlap
the next phrase's by SPAN - 1. No phrase is a proper prefix of another one with the same trigger place, the text is the
sequence of its phrases, and equal phrases are stored and compared once: the dictionary.

Order: the suffixes of the corpus that matter, those that share at least GRAM bytes from a trigger on, are brought
together by one distributed sort of (trigger hash, phrase hash, doc_id), a row for each phrase instead of each byte.
This is hash order, not suffix order: it only brings equal strings together. The first row of a phrase is its smallest document; all later ones are covered whole. Phrases that share
a trigger, and a side of it, with a different phrase can still share windows; only they are spread out into windows,
sorted by (window hash, doc_id), and read the same way. So repetitive text costs one row a phrase, and text that
nothing else shares never gets beyond the first sort.

Hashes have 64 bits. The sorted runs are read as streams, so a run may be of any length and is no group in memory. A trigger,
phrase or window that outweighs a task, as a header that a third of all documents hold, is dealt to several: a phrase or window
by document, a trigger's other phrases by phrase. Each task then knows only the first document of its own share, so these few
rows are marked, the smallest of a key is found among them, and it decides about the others. Which keys outweigh a task is told
by a random part of the texts, as a range sort tells its bounds: this decides where rows go, never what becomes of them.

Defined cases: texts shorter than SPAN bytes and null texts (empty) lose nothing; very long texts are parsed whole; of texts
that tie, as equal ones, the smallest doc_id keeps its bytes; rows with a null doc_id lose nothing and cover nothing; rows
that share a doc_id never cover each other; an empty table gives an empty result; further columns, whatever their names,
are ignored by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import boxed, materialize, slices, texts
from lectern.llm.textops import mix, powers, prefix_sums, runs, span_hash, views

#: Bytes of a string whose repetition counts, and bytes of the rolling hash; each string has SPAN - GRAM + 1 of them.
SPAN, GRAM = 50, 20
#: Rows of one trigger that are held at a time to see which of its phrases are alike; beyond it all count as alike.
MOST_HELD = 1 << 20
#: Part of the texts that tells which keys are hot; the part of a task's rows beyond which a key is, and the least rows of it.
SAMPLE, HOT, LEAST_ROWS = 1 / 64, 0.25, 64
_LOW = np.uint64(0xFFFF)


def phrases(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start, trigger hash, content hash and document of every phrase."""
    n = len(raw)
    z = np.zeros(0, np.int64)
    lengths = np.diff(off)
    starts_per = np.maximum(0, lengths - SPAN + 1)
    if not starts_per.sum():
        return z, z, z.astype(np.uint64), z.astype(np.uint64), z
    sums = prefix_sums(raw)
    _, down = powers(n + 1)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, have = SPAN - GRAM + 1, 1
    while 2 * have <= width:
        key = np.minimum(key[: len(key) - have], key[have:])
        have *= 2
    if have < width:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    valid = np.zeros(n + 1, np.int32)
    full = starts_per > 0
    np.add.at(valid, off[:-1][full], 1)
    np.add.at(valid, off[:-1][full] + starts_per[full], -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]))
    trigger = (key[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    at = np.flatnonzero(new)
    first = s[at]
    last = s[np.append(at[1:], len(s)) - 1]
    t = trigger[at]
    doc = np.searchsorted(off, first, "right") - 1
    content = span_hash(sums, first, last + SPAN)
    # a string holds half of SPAN - GRAM on one side of the trigger at least: eight bits of each side's hash
    half = (SPAN - GRAM) // 2
    left = np.where(t - half >= off[doc], span_hash(sums, np.maximum(t - half, 0), t), content)
    right = np.where(t + GRAM + half <= off[doc + 1], span_hash(sums, t + GRAM, np.minimum(t + GRAM + half, n)), content)
    group = (h[t] >> np.uint64(16) << np.uint64(16)) | (left & np.uint64(0xFF)) << np.uint64(8) | right & np.uint64(0xFF)
    return first, last, group, content, doc


def parse(docs: DataFrame) -> DataFrame:
    """(trigger, phrase, doc_id): the distinct phrases of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, _, group, content, doc = phrases(*views(part.column("text")))
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)[doc]
            order = np.lexsort((content, ids))
            g, c, d = group[order], content[order], ids[order]
            new = np.ones(len(c), bool)
            new[1:] = (c[1:] != c[:-1]) | (d[1:] != d[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[new], pa.int64()) for x in (g.view(np.int64), c.view(np.int64), d.astype(np.int64))], ["trigger", "phrase", "doc_id"])

    return texts(docs).where("doc_id is not null").mapInArrow(run, "trigger long, phrase long, doc_id long")


def repeated(keys: np.ndarray) -> np.ndarray:
    _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[number] > 1


def judge(group: np.ndarray, content: np.ndarray, doc: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows of whole triggers: which are covered whole, and which have to be compared window by window."""
    top = group >> np.uint64(16)
    new_top = np.ones(len(top), bool)
    new_top[1:] = top[1:] != top[:-1]
    new = new_top.copy()
    new[1:] |= (group[1:] != group[:-1]) | (content[1:] != content[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    covered = doc > doc[first]
    number = np.cumsum(new_top) - 1
    begin = np.flatnonzero(new_top)
    several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
    some = np.flatnonzero(new & several[number])
    if not len(some):
        return covered, new & hot
    side = lambda shift: repeated((number[some] << 8) | ((group[some] >> np.uint64(shift)) & np.uint64(0xFF)).astype(np.int64))
    alike = np.zeros(len(new), bool)
    alike[some] = side(0) | side(8)
    return covered, alike | new & hot


def read_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, phrase, covered) from rows sorted by trigger, phrase and doc_id."""
    held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    hot = None

    def told(rows: list[np.ndarray], force: bool) -> pa.RecordBatch:
        flag = np.full(len(rows[0]), force) if hot is None or force else (rows[0] >> np.uint64(16)) == hot
        covered, alike = judge(*rows, flag)
        keep = covered | alike
        return pa.RecordBatch.from_arrays([pa.array(rows[2][keep]), pa.array(rows[1][keep].view(np.int64)), pa.array(covered[keep])], ["doc_id", "phrase", "covered"])

    for batch in batches:
        more = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("trigger", "phrase", "doc_id")]
        held = [np.concatenate([a, b.view(a.dtype)]) for a, b in zip(held, more, strict=True)]
        top = held[0] >> np.uint64(16)
        cut = int(np.flatnonzero(np.append(True, top[1:] != top[:-1]))[-1]) if len(top) else 0
        if cut:
            yield told([x[:cut] for x in held], False)
            held, hot = [x[cut:] for x in held], None
        if len(held[0]) > MOST_HELD:
            now = held[0][0] >> np.uint64(16)
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(new):
                yield told([x[: new[-1] + 1] for x in held], True)
                held = [x[new[-1] + 1 :] for x in held]
            else:  # one phrase: its first row is enough to judge what follows
                out = told(held, True)
                yield out.filter(out.column("covered"))
                held = [x[:1] for x in held]
            hot = now
    if len(held[0]):
        yield told(held, False)


def windows(table: DataFrame) -> DataFrame:
    """(window, doc_id): the distinct windows of the phrases in ``alike``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, off = views(part.column("text"))
            first, last, _, content, doc = phrases(raw, off)
            mine = member(content, doc, part.column("alike"))
            length = (last - first + 1)[mine]
            s = np.repeat(first[mine] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
            h = span_hash(prefix_sums(raw), s, s + SPAN)
            ids = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)[doc[mine]], length) if len(s) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids, pa.int64())], ["window", "doc_id"])

    return table.where(F.size("alike") > 0).select("doc_id", "text", "alike").mapInArrow(run, "window long, doc_id long")


Place = tuple[tuple[int, ...], int] | None  # the keys of the latest run and its first document


def first_docs(keys: list[np.ndarray], doc: np.ndarray, last: Place) -> tuple[np.ndarray, Place]:
    """The document of the first row in each row's run (rows of equal keys), and what the next batch has to know."""
    new = np.ones(len(doc), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))].copy()
    if last and last[0] == tuple(int(k[0]) for k in keys):
        least[: int(np.flatnonzero(np.append(new[1:], True))[0]) + 1] = last[1]
    return least, (tuple(int(k[-1]) for k in keys), int(least[-1]))


def columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def read_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, window) of windows that a smaller document has, from rows sorted by window and doc_id."""
    last: Place = None
    for batch in batches:
        if batch.num_rows:
            w, d = columns(batch, "window", "doc_id")
            least, last = first_docs([w], d, last)
            yield pa.RecordBatch.from_arrays([pa.array(d[d > least]), pa.array(w[d > least])], ["doc_id", "window"])


def read_dealt_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, window, lead) from rows sorted by window, salt and doc_id: also the first rows of hot windows, as leads."""
    last: Place = None
    for batch in batches:
        if batch.num_rows:
            w, salt, d = columns(batch, "window", "salt", "doc_id")
            least, last = first_docs([w, salt], d, last)
            lead = (d == least) & (salt > 0)
            keep = lead | (d > least)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (d, w, lead)], ["doc_id", "window", "lead"])


def read_dealt_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, phrase, covered, lead) from rows sorted by salt, trigger, phrase and doc_id.

    Rows without a salt are whole triggers, and come first. Of the others, all phrases count as alike; the first rows of hot ones
    are leads.
    """
    rest: list[pa.RecordBatch] = []

    def whole() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = int(np.searchsorted(columns(batch, "salt")[0], 0, "right"))
            if n:
                yield batch.slice(0, n)
            if n < batch.num_rows:
                rest.append(batch.slice(n))
                return

    for out in read_runs(whole()):
        yield out.append_column("lead", pa.array(np.zeros(out.num_rows, bool)))
    last: Place = None
    for batch in chain(rest, batches):
        if batch.num_rows:
            salt, trigger, phrase, doc, hot = columns(batch, "salt", "trigger", "phrase", "doc_id", "hot")
            least, last = first_docs([salt, trigger, phrase], doc, last)
            arrays = doc, phrase, doc > least, (doc == least) & hot.astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["doc_id", "phrase", "covered", "lead"])


def member(values: np.ndarray, doc: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether values[i] is in the list of its document."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
    salt = mix(np.arange(len(lists), dtype=np.uint64))
    return np.isin(mix(values) ^ salt[doc], mix(flat.view(np.uint64)) ^ np.repeat(salt, sizes))


def marked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and which bytes to remove, of rows with text, covered and windows."""
    raw, off = views(part.column("text"))
    first, last, _, content, doc = phrases(raw, off)
    change = np.zeros(len(raw) + 1, np.int32)
    mine = member(content, doc, part.column("covered"))
    np.add.at(change, first[mine], 1)
    np.add.at(change, last[mine] + SPAN, -1)
    rest = ~mine & (np.array([0 if n is None else n for n in pc.list_value_length(part.column("windows")).to_pylist()], np.int64) > 0)[doc] if len(doc) else mine
    length = (last - first + 1)[rest]
    s = np.repeat(first[rest] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    hit = s[member(span_hash(prefix_sums(raw), s, s + SPAN), np.repeat(doc[rest], length), part.column("windows"))] if len(s) else s
    np.add.at(change, hit, 1)
    np.add.at(change, hit + SPAN, -1)
    return raw, off, np.cumsum(change[:-1]) > 0


def top_of(trigger: Column) -> Column:
    return F.shiftright(trigger, 16)


def hot_keys(sample: DataFrame, key: str, parts: int) -> DataFrame | None:
    """(key, salts) of the keys that outweigh a task: how many tasks share its rows. There are at most parts / HOT of them."""
    most = max(sample.count() * HOT / parts, LEAST_ROWS)
    found = [(r[key], int(r["n"] / most) + 1) for r in sample.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()]
    return sample.sparkSession.createDataFrame(found, f"{key} long, salts int") if found else None


def led(found: DataFrame, key: str, so_far: Column) -> DataFrame:
    """``found`` with ``covered``: so far, or a lead whose key has a smaller lead. Leads are fewer than two for each salt of a key."""
    first = found.where("lead").groupBy(key).agg(F.min("doc_id").alias("first"))
    covered = so_far | (F.col("lead") & (F.col("doc_id") > F.col("first")))
    return found.join(F.broadcast(first), key, "left").withColumn("covered", F.coalesce(covered, F.lit(False))).drop("lead", "first")


def known_phrases(rows: DataFrame, parts: int) -> DataFrame:
    """(doc_id, phrase, covered) of the phrases that are covered whole or have to be compared window by window."""
    sample = materialize(parse(rows.sample(SAMPLE, 7)), "sampled-phrases").withColumn("top", top_of(F.col("trigger")))
    tops = hot_keys(sample, "top", parts)
    every, order = parse(rows), ["trigger", "phrase", "doc_id"]
    if tops is None:
        dealt = every.repartition(parts, top_of(F.col("trigger"))).sortWithinPartitions(*order)
        return materialize(dealt.mapInArrow(read_runs, "doc_id long, phrase long, covered boolean"), "phrases")
    hot = hot_keys(sample, "phrase", parts)
    every = every.withColumn("top", top_of(F.col("trigger"))).join(F.broadcast(tops), "top", "left")
    every = every.withColumn("shares", F.lit(None).cast("int")) if hot is None else every.join(F.broadcast(hot.withColumnRenamed("salts", "shares")), "phrase", "left")
    salt = F.when(F.col("salts").isNull(), 0).when(F.col("shares").isNull(), 1 + F.pmod(F.xxhash64("phrase"), "salts")).otherwise(1 + F.pmod(F.xxhash64("doc_id"), "shares"))
    every = every.select(*order, "top", salt.cast("int").alias("salt"), (F.col("salts").isNotNull() & F.col("shares").isNotNull()).alias("hot"))
    dealt = every.repartition(parts, "top", "salt").select("salt", "hot", *order).sortWithinPartitions("salt", *order)
    return led(materialize(dealt.mapInArrow(read_dealt_runs, "doc_id long, phrase long, covered boolean, lead boolean"), "phrases"), "phrase", F.col("covered"))


def known_windows(held: DataFrame, parts: int) -> DataFrame:
    """(doc_id, window) of the windows that a smaller document has."""
    hot = hot_keys(materialize(windows(held.sample(SAMPLE, 7)), "sampled-windows"), "window", parts)
    spread = windows(held)
    if hot is None:
        dealt = spread.repartition(parts, "window").sortWithinPartitions("window", "doc_id")
        return materialize(dealt.mapInArrow(read_windows, "doc_id long, window long"), "windows")
    salt = F.coalesce(1 + F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)).cast("int")
    spread = spread.join(F.broadcast(hot), "window", "left").select("window", salt.alias("salt"), "doc_id")
    dealt = spread.repartition(parts, "window", "salt").sortWithinPartitions("window", "salt", "doc_id")
    return led(materialize(dealt.mapInArrow(read_dealt_windows, "doc_id long, window long, lead boolean"), "windows"), "window", ~F.col("lead")).where("covered").drop("covered")


def judged(rows: DataFrame) -> tuple[DataFrame, str]:
    """(row, doc_id, text, covered, windows) of ``boxed`` rows: the phrases of a text, and its windows, that are repeated.

    Also the name of the table of parsed texts that they are read from.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = known_phrases(rows, parts)
    listed = found.groupBy("doc_id").agg(F.collect_list(F.when(F.col("covered"), F.col("phrase"))).alias("covered"), F.collect_list(F.when(~F.col("covered"), F.col("phrase"))).alias("alike"))
    table = f"parsed_texts_{uuid.uuid4().hex}"
    rows.join(listed, "doc_id", "left").write.format("parquet").option("compression", "zstd").bucketBy(parts, "doc_id").sortBy("doc_id").saveAsTable(table)
    held = spark.table(table)
    seen = known_windows(held.select("doc_id", "text", "alike"), parts)
    per_doc = seen.groupBy("doc_id").agg(F.collect_set("window").alias("windows"))
    return held.drop("alike").join(per_doc, "doc_id", "left"), table


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, off, gone = marked(part)
            sums = np.concatenate([[0], np.cumsum(gone)])
            starts, _, doc = runs(gone, off)
            n_spans = np.bincount(doc, minlength=part.num_rows) if len(doc) else np.zeros(part.num_rows, np.int64)
            kept, ends = raw[~gone], np.arange(len(raw) + 1) - sums
            digests = [hashlib.sha256(kept[ends[a] : ends[b]]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(off)), pa.array(np.diff(sums[off])), pa.array(n_spans, pa.int64()), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows, table = judged(texts(docs))
    out = materialize(rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "repeats")
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes of each text removed; characters cut in two are replaced. All columns stay.

    The result reads the table of parsed texts, which stays in the catalog.
    """
    rows = judged(boxed(docs))[0].select("row", "text", "covered", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw, off, gone = marked(part)
            kept, ends = raw[~gone], np.arange(len(raw) + 1) - np.concatenate([[0], np.cumsum(gone)])
            texts_ = [kept[ends[a] : ends[b]].tobytes().decode("utf-8", "replace") for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts_, pa.string())], ["row", "text"])

    out = rows.mapInArrow(run, rows.select("row", "text").schema)
    return out.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
