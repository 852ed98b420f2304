"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors are quantised to whole numbers, sorted along a Hilbert curve through their most varying dimensions and written as
Parquet in blocks of ``1 << BLOCK_BITS`` rows. A zone map keeps, for each block, the least and the largest value of every dimension, the
labels and the smallest id. The inner product of an anchor with anything in a block lies between two sums over dimensions
(interval arithmetic), so a block is read for an anchor only if that interval, cut to the anchor's window, may still hold a row
that is better than the worst one the anchor has so far.

Four rounds: an anchor meets its own block (a first bound), then the blocks that may still hold one of its positives; then the
same for the windows below each positive. Blocks and anchors meet in units of one block and one slice of the anchors: the rows of
a unit are sorted so that the block comes first and is held, and the anchors pass by in parts, so no task holds more,
however many anchors want a block. Where vectors have no structure, every interval is wide and all blocks are read: the result
is the same, at the cost of a comparison of all anchors with all rows.

Scores are exact: products are taken in floating point only where all sums stay below 2**53, then in 64 bits, and beyond those in
Python's integers, cut to 64 bits.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; a null vec_id is a row like
others, last in ties; rows repeated in the table are rows of their own (a copy of an anchor is one of its positives); shorter
vectors are filled with zeros; an anchor without positives, or a positive without negatives in its window, has no rows; an empty
table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize

#: Rows of a block (a power of two); anchors of a slice; blocks of a part of the zone map; anchors that meet a block at a time.
BLOCK_BITS = 10
SLICE = 4096
ZONES = 64
PASSING = 512
#: Dimensions of the Hilbert curve, and bits for each.
CURVE_DIMS, CURVE_BITS = 8, 4
#: Quantisation steps, which rows are anchors, positives of an anchor, negatives of a positive, and the window
#: of a negative's score in hundredths of the positive's.
STEPS = 256
EVERY = 100
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
#: Stands for a null id, after all others, and for "no bound yet".
LAST = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min

MEETS = ["block", "slice"]


def relabelled(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v): the rows that take part, with the contract's labels and quantised vectors."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    label = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * STEPS)).alias("v"))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of equal width, filled with zeros."""
    values, sizes = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    size = most(a) * most(b) * max(1, a.shape[1])
    if size < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if size < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), LOWEST + 1, LAST).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of coordinates below 2**bits)."""
    x = cells.astype(np.uint64).T.copy()
    if not len(x):
        return np.zeros(cells.shape[0], np.int64)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):  # undo the turns of the sub-cubes, the largest first
        low = np.uint64((1 << level) - 1)
        for axis in range(len(x)):
            turned = (x[axis] >> np.uint64(level)) & one == one
            swap = np.where(turned, 0, (x[0] ^ x[axis]) & low).astype(np.uint64)
            x[0] ^= np.where(turned, low, 0).astype(np.uint64)
            x[0] ^= swap
            x[axis] ^= swap
    for axis in range(1, len(x)):  # Gray code over the axes
        x[axis] ^= x[axis - 1]
    flips = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flips
    place = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << one) | ((axis >> np.uint64(level)) & one)
    return place.astype(np.int64)


def spread(rows: DataFrame) -> list:
    """(dim, n, mean, deviation) of each dimension, as many rows as the vectors have dimensions; sums are taken in the tasks first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = int(batch.column("v").value_lengths().to_numpy(zero_copy_only=False).max(initial=0))
            m = matrix(batch.column("v"), width).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, len(m))), pa.array(m.sum(0)), pa.array((m * m).sum(0))], ["dim", "n", "s", "ss"])

    sums = rows.select("v").mapInArrow(partial, "dim long, n long, s double, ss double").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    mean = F.col("s") / F.col("n")
    return sums.select("dim", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)).alias("deviation")).collect()


class Blocks:
    """The rows in Hilbert order, in blocks, with their zone map: two tables in the shared folder."""

    def __init__(self, rows: DataFrame):
        known = spread(rows)
        self.width = 1 + max((r["dim"] for r in known), default=-1)
        widest = sorted(known, key=lambda r: (-r["deviation"], r["dim"]))[:CURVE_DIMS]
        dims, mean = [r["dim"] for r in widest], np.array([r["mean"] for r in widest])
        unit = np.array([max(r["deviation"], 1e-9) for r in widest])
        width, half = self.width, 1 << CURVE_BITS - 1

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = matrix(batch.column("v"), width)[:, dims]
                # four standard deviations either way fill the grid; what lies beyond is in the outer cells
                cells = np.clip(np.floor((m - mean) / unit * (half / 4) + half), 0, 2 * half - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, CURVE_BITS))], [*batch.schema.names, "curve"])

        # equal vectors have one place on the curve, so the id's hash deals them to several partitions
        along = rows.mapInArrow(placed, "vec_id long, label long, v array<long>, curve long").withColumn("salt", F.xxhash64("vec_id"))
        ordered = along.repartitionByRange("curve", "salt").sortWithinPartitions("curve", "salt").select(F.monotonically_increasing_id().alias("no"), "vec_id", "label", "v")
        self.rows = materialize(ordered.select("no", F.shiftright("no", BLOCK_BITS).alias("block"), "vec_id", "label", "v"), "hilbert-blocks")
        self.zones = materialize(self.zone_map(), "zone-map")
        self.n_blocks = self.zones.count()

    def zone_map(self) -> DataFrame:
        """(block, lo, hi, labels, first_id): a row for each block."""
        width = self.width
        names = ["block", "lo", "hi", "labels", "first_id"]

        def zone(block: int, lo: np.ndarray, hi: np.ndarray, labels: list, first: int) -> list:
            return [block, lo.tolist(), hi.tolist(), labels, first]

        def batch_of(zones: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*zones, strict=True), kinds, strict=True)], names)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                block, label = batch.column("block").to_numpy(), batch.column("label").to_numpy()
                ids, m = batch.column("vec_id").fill_null(LAST).to_numpy(), matrix(batch.column("v"), width)
                out = []
                for b in np.unique(block):
                    own = block == b
                    out.append(zone(int(b), m[own].min(0), m[own].max(0), np.unique(label[own]).tolist(), int(ids[own].min())))
                if out:
                    yield batch_of(out)

        def merged(table: pa.Table) -> pa.Table:  # the parts of one block: as many as batches that held some of its rows
            lo, hi = (np.array(table.column(c).to_pylist(), np.int64).reshape(table.num_rows, width) for c in ("lo", "hi"))
            labels = sorted(set(sum(table.column("labels").to_pylist(), [])))
            return pa.Table.from_batches([batch_of([zone(table.column("block")[0].as_py(), lo.min(0), hi.max(0), labels, min(table.column("first_id").to_pylist()))])])

        kind = "block long, lo array<long>, hi array<long>, labels array<long>, first_id long"
        return self.rows.select("block", "label", "vec_id", "v").mapInArrow(partial, kind).groupBy("block").applyInArrow(merged, kind)


def passing(unit: list[str], handle: Callable[[pa.RecordBatch, pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows sorted by unit and side: hold a unit's rows of side 0, then let those of side 1 pass by in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in [*unit, "side"]])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                mine, side = tuple(keys[:-1, a].tolist()), keys[-1, a]
                if mine != now:
                    now, parts, held = mine, [], None
                if side == 0:
                    parts.append(batch.slice(a, b - a))
                    continue
                if not parts:
                    continue
                if held is None:
                    held = pa.concat_batches(parts)
                for at in range(a, b, PASSING):
                    yield from handle(held, batch.slice(at, min(PASSING, b - at)))

    return run


def meet(resident: DataFrame, probes: DataFrame, unit: list[str], handle: Callable, schema: str) -> DataFrame:
    """``handle`` for each unit's resident rows and parts of its probes."""
    both = resident.withColumn("side", F.lit(0)).unionByName(probes.withColumn("side", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*unit).sortWithinPartitions(*unit, "side").mapInArrow(passing(unit, handle), schema)


#: An anchor on its way: its windows are one for each thing it looks for (from, to, and the worst score and id that it has).
ANCHOR = "no long, label long, v array<long>, slice long, home long, windows array<struct<low:bigint,high:bigint,worst:bigint,worst_id:bigint>>"
FOUND = "no long, k int, score long, vec_id long"


def windows_of(probes: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
    """Number, rows and bounds of the first, second, ... windows of the anchors that have so many."""
    col = probes.column("windows")
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    flat, begin = col.flatten(), np.cumsum(sizes) - sizes
    fields = [flat.field(c).fill_null(none).to_numpy() for c, none in (("low", LOWEST), ("high", LAST), ("worst", LOWEST), ("worst_id", LAST))]
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        yield k, rows, tuple(f[begin[rows] + k][:, None] for f in fields)


def wanted(blocks: Blocks, anchors: DataFrame, same: bool) -> DataFrame:
    """ANCHOR rows with each block, besides their own, that may hold a better row for one of their windows."""
    width, parts = blocks.width, max(1, -(-blocks.n_blocks // ZONES))

    def choose(zones: pa.RecordBatch, probes: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        a, lo, hi = matrix(probes.column("v"), width), matrix(zones.column("lo"), width), matrix(zones.column("hi"), width)
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        most, least = product(up, hi) + product(down, lo), product(up, lo) + product(down, hi)
        first, block = zones.column("first_id").to_numpy(), zones.column("block").to_numpy()
        label = probes.column("label").to_numpy()
        sets, known = [set(x) for x in zones.column("labels").to_pylist()], np.unique(label)
        fits = np.array([[(x in s) if same else len(s) > 1 or x not in s for s in sets] for x in known.tolist()]).reshape(len(known), len(sets))
        ok = fits[np.searchsorted(known, label)] & (block[None, :] != probes.column("home").to_numpy()[:, None])
        need = np.zeros(ok.shape, bool)
        for _, rows, (low, high, worst, worst_id) in windows_of(probes):
            top = np.minimum(most[rows], high)
            better = (top > worst) | (top == worst) & (first[None, :] < worst_id)
            need[rows] |= (np.maximum(least[rows], low) <= top) & better
        who, where = np.nonzero(need & ok)
        if len(who):
            names = ["no", "label", "v", "slice", "home", "windows"]
            taken = [probes.column(c).take(pa.array(who)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(block[where]), *taken], ["block", *names])

    slices = anchors.agg(F.max("slice")).first()[0] or 0
    zones = blocks.zones.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices).cast("long"))))
    every = anchors.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return meet(zones, every, ["part", "slice"], choose, f"block long, {ANCHOR}")


def scored(blocks: Blocks, probes: DataFrame, same: bool, most: int) -> DataFrame:
    """FOUND: of each block that an anchor meets, the best ``most`` rows in each of its windows, if better than what it has."""
    width = blocks.width

    def best(held: pa.RecordBatch, passing: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores = product(matrix(passing.column("v"), width), matrix(held.column("v"), width))
        ids, unknown = held.column("vec_id").fill_null(LAST).to_numpy(), held.column("vec_id").is_null().to_numpy(zero_copy_only=False)
        alike = passing.column("label").to_numpy()[:, None] == held.column("label").to_numpy()[None, :]
        no = passing.column("no").to_numpy()
        other = (alike if same else ~alike) & (no[:, None] != held.column("no").to_numpy()[None, :])
        for k, rows, (low, high, worst, worst_id) in windows_of(passing):
            s = scores[rows]
            who, what = np.nonzero(other[rows] & (s >= low) & (s <= high) & ((s > worst) | (s == worst) & (ids[None, :] < worst_id)))
            got = s[who, what]
            order = np.lexsort((ids[what], -got, who))
            who, what, got = who[order], what[order], got[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            keep = rank < most
            if keep.any():
                who, what, got = who[keep], what[keep], got[keep]
                yield pa.RecordBatch.from_arrays([pa.array(no[rows[who]]), pa.array(np.full(len(who), k, np.int32)), pa.array(got), pa.array(ids[what], mask=unknown[what])], ["no", "k", "score", "vec_id"])

    units = probes.select("block", "slice").distinct()
    resident = blocks.rows.select("block", "no", "vec_id", "label", "v").join(units, "block")
    return meet(resident, probes, MEETS, best, FOUND)


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The best rows of each anchor and window, with their rank."""
    order = Window.partitionBy("no", "k").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def searched(blocks: Blocks, anchors: DataFrame, same: bool, most: int) -> DataFrame:
    """FOUND with rank: the best ``most`` rows of each window of ``anchors`` (columns of ANCHOR), exactly."""
    near = materialize(first_of(scored(blocks, anchors.withColumn("block", F.col("home")), same, most), most).drop("rank"), "home-block")
    full = F.count(F.lit(1)) == most
    worst = near.groupBy("no", "k").agg(F.when(full, F.min("score")).alias("worst"), F.when(full, F.min(F.struct("score", -F.coalesce("vec_id", F.lit(LAST))))).alias("x"))
    # the last of a full list: the lowest score, and among those the largest id
    bounds = worst.groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("worst", (-F.col("x")["col2"]).alias("worst_id"))))).alias("bounds"))
    tight = F.transform("windows", lambda w, k: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.col("bounds")[k.cast("int")]["worst"].alias("worst"), F.col("bounds")[k.cast("int")]["worst_id"].alias("worst_id")))
    ready = materialize(anchors.join(bounds, "no", "left").withColumn("windows", tight).drop("bounds"), "bounded-anchors")
    more = scored(blocks, materialize(wanted(blocks, ready, same), "wanted-blocks"), same, most)
    return materialize(first_of(near.unionByName(more), most), "best-rows")


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from (vec_id, label, v)."""
    blocks = Blocks(rows)
    picked = blocks.rows.where(F.col("vec_id") % EVERY == 0)
    slices = max(1, -(-picked.count() // SLICE))
    anchors = picked.select("no", "label", "v", F.pmod(F.xxhash64("no"), F.lit(slices)).alias("slice"), F.col("block").alias("home"))
    bound = lambda c: c.cast("long")
    open_window = F.array(F.struct(*[bound(F.lit(None)).alias(c) for c in ("low", "high", "worst", "worst_id")]))
    positives = searched(blocks, anchors.withColumn("windows", open_window), True, POSITIVES)
    score = F.col("score").cast("decimal(38,0)")
    low, high = -F.floor(-score * WINDOW[0] / 100), F.floor(score * WINDOW[1] / 100)
    each = positives.select("no", F.struct("rank", bound(low).alias("low"), bound(high).alias("high")).alias("x"))
    in_order = each.groupBy("no").agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most POSITIVES of them
    windows = F.transform("x", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"), bound(F.lit(None)).alias("worst"), bound(F.lit(None)).alias("worst_id")))
    negatives = searched(blocks, anchors.join(in_order.select("no", windows.alias("windows")), "no"), False, NEGATIVES)
    a = picked.select("no", F.col("vec_id").alias("anchor_id"))
    p = positives.select("no", (F.col("rank") - 1).alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = negatives.select("no", "k", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return n.join(p, ["no", "k"]).join(a, "no").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's hard negatives of ``embeddings`` (vec_id, embedding, label)."""
    return mine(relabelled(embeddings))
