"""Nearest neighbours: by a scan, and by cells around trained centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import rounded
from lectern.operators.relational import settled_rows

#: Rows on which the centres of a cell index are trained, at most.
TRAIN_ROWS = 10_000
#: Rows of a cell and queries that meet at a time, and rows of a cell that one task compares.
BLOCK, SLICE, SHARE = 2048, 512, 16_384
BLOCKED = "cell int, deal int, ids binary, vectors binary"


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(norm != 0, norm))


def nearest(df: DataFrame, id_: str, vector: str, probe_id, k: int) -> DataFrame:
    """The k rows nearest to one row (not itself): one broadcast row, one scan, a top-k for each task."""
    probe = df.where(F.col(id_) == F.lit(probe_id)).limit(1).select(F.col(vector).alias("_probe"))
    scored = df.where(F.col(id_) != F.lit(probe_id)).crossJoin(F.broadcast(probe)).withColumn("distance", F.round(l2(F.col(vector), F.col("_probe")), 4))
    return scored.drop("_probe").orderBy("distance", id_).limit(k)


class CellIndex:
    """Vectors by the cell of their nearest centre, for searches that read the cells around a query first.

    Centres are trained on at most ``TRAIN_ROWS`` rows (by the order of a hash of the id); every row is indexed. A cell has a radius,
    the largest distance of its rows from the centre, so by the triangle inequality no row of a cell is nearer to a query than the
    centre's distance less the radius: ``search`` without ``probes`` is exact and leaves out cells that are too far.
    """

    def __init__(self, rows: DataFrame, id_column: str, column: str, cells: int = 64, rounds: int = 8):
        self.spark = rows.sparkSession
        named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x))")
        sample = np.array([r["v"] for r in named.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("v").toLocalIterator()])
        centres = sample[:: max(1, len(sample) // cells)][:cells].copy() if len(sample) else np.zeros((1, 1))
        for _ in range(rounds if len(sample) else 0):
            own = squared(sample, centres).argmin(1)
            for c in np.unique(own):
                centres[c] = sample[own == c].mean(0)
        self.centres = centres

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    d = squared(np.array(batch.column("v").to_pylist()), centres)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(np.sqrt(d.min(1)))], ["id", "v", "cell", "off"])

        # rows of a large cell are dealt to several files by their id
        placed = named.mapInArrow(assign, "id long, v array<double>, cell int, off double")
        self.rows = settled_rows(placed.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell"))
        cells_held = self.rows.groupBy("cell").agg(F.max("off").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # as many as cells
        self.radius = {r["cell"]: r["radius"] for r in cells_held}
        self.deals = {r["cell"]: -(-r["n"] // SHARE) for r in cells_held}

    def blocks(self) -> DataFrame:
        """(cell, deal, ids, vectors): up to BLOCK rows of a cell each; the blocks of a large cell are dealt to several tasks."""
        deals, most = self.deals, BLOCK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell, ids, v = batch.column("cell").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"))
                order = np.argsort(cell, kind="stable")
                for start, end in cut(cell[order], most):
                    rows = order[start:end]
                    c = int(cell[rows[0]])
                    yield one_row(c, int(ids[rows[0]]) % deals[c], ids[rows].tobytes(), v[rows].tobytes())

        return self.rows.select("id", "v", "cell").mapInArrow(run, BLOCKED)

    def near_cells(self, queries: DataFrame) -> DataFrame:
        """(query, q, home, nth, least): of each cell that holds rows, the place by the distance of its centre, and the least distance
        of a row in it; home is the first one."""
        centres, known = self.centres, sorted(self.radius)
        radius = np.array([self.radius[c] for c in known])

        def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch) or not known:
                    continue
                d = np.sqrt(squared(matrix(batch.column("q")), centres[known]))
                nth = d.argsort(1).argsort(1)
                lists = lambda x: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32)), lists(nth.astype(np.int32)), lists(d - radius[None, :])], ["query", "q", "home", "nth", "least"])

        return queries.select("query", F.col("q").cast("array<double>").alias("q")).mapInArrow(order, "query long, q array<double>, home int, nth array<int>, least array<double>")

    def distances(self, near: DataFrame, blocks: DataFrame, k: int, low: int, high: int, decimals: int, others: bool) -> DataFrame:
        """(query, id, distance) of rows in the cells from place ``low`` to before ``high`` of each query: all that may be among its ``k``
        nearest. ``near`` has the columns of ``near_cells`` and the distance of the worst row so far, or null."""
        known, deals, most, slack = sorted(self.radius), self.deals, SLICE, 1e-9 + 10.0**-decimals

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                ids, q, nth, least = batch.column("query").to_numpy(), *(matrix(batch.column(c)) for c in ("q", "nth", "least"))
                reach = batch.column("worst").fill_null(np.inf).to_numpy() + slack
                wanted = (nth >= low) & (nth < high) & (least <= reach[:, None])
                asked = np.concatenate([reach[:, None], q], 1)
                for at, c in enumerate(known):
                    mine = np.flatnonzero(wanted[:, at])
                    for start in range(0, len(mine), most):
                        part = mine[start : start + most]
                        for deal in range(deals[c]):
                            yield one_row(c, deal, ids[part].tobytes(), asked[part].tobytes())

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(len(batch)):
                    query, asked, ids, v = (np.frombuffer(batch.column(c)[at].as_buffer(), t) for c, t in (("query", np.int64), ("asked", float), ("ids", np.int64), ("vectors", float)))
                    asked, v = asked.reshape(len(query), -1), v.reshape(len(ids), -1)
                    found = nearest_rows(query, asked[:, 1:], asked[:, 0], ids, v, k, slack, others)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query", "id", "distance"])

        slices = near.sort("home", "query").mapInArrow(ask, BLOCKED).withColumnsRenamed({"ids": "query", "vectors": "asked"})
        return slices.join(blocks, ["cell", "deal"]).select("query", "asked", "ids", "vectors").mapInArrow(meet, "query long, id long, distance double")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, first: int = 4, decimals: int = 9, others: bool = False) -> DataFrame:
        """(query, rank, id, distance): the ``k`` nearest rows of each query (query, q): of the nearest ``probes`` cells, or of all.

        Distances are ranked as rounded to ``decimals``, equal ones by id; with ``others``, no row that has the query's id counts.
        Without ``probes``, ``first`` cells are read; then those that may hold a row as near as the k-th so far, rounding included.
        Blocks of rows meet slices of queries, and only rows that may be among the k nearest leave a block.
        """
        near, blocks = settled_rows(self.near_cells(queries)), settled_rows(self.blocks())
        nothing = near.withColumn("worst", F.lit(None).cast("double"))
        got = self.distances(nothing, blocks, k, 0, probes or first, decimals, others)
        if probes is None:
            got = settled_rows(best(got, k, decimals).drop("rank"))
            worst = got.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("worst"))
            got = got.unionByName(self.distances(near.join(worst, "query", "left"), blocks, k, first, len(self.radius), decimals, others))
        return best(got, k, decimals)


def one_row(cell: int, deal: int, ids: bytes, vectors: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([deal], pa.int32()), pa.array([ids], pa.binary()), pa.array([vectors], pa.binary())], ["cell", "deal", "ids", "vectors"])


def matrix(col: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def cut(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of equal keys, ``most`` rows at a time."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=False):
        for at in range(start, end, most):
            yield at, min(at + most, end)


def nearest_rows(query: np.ndarray, q: np.ndarray, reach: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, slack: float, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and distance of the rows of a block that may be among the ``k`` nearest of a query, and no farther than its reach.

    Products tell which rows are out of reach; the distance of the rest is summed as ``l2`` does. Rows as far as the k-th but for
    ``slack`` stay, of equally far ones the k smallest ids.
    """
    d = squared(q, v)
    size = (q * q).sum(1).max(initial=0) + (v * v).sum(1).max(initial=0)
    error = 1e-12 * (1 + size)  # more than the products' rounding
    if others:
        d[query[:, None] == ids[None, :]] = np.inf
    near = d <= (reach**2)[:, None] + error
    if others:
        near &= d < np.inf
    full = np.flatnonzero(near.sum(1) > k)
    if len(full):
        kth = np.partition(d[full], k - 1, 1)[:, k - 1]
        near[full] &= d[full] <= ((np.sqrt(kth + error) + slack) ** 2 + error)[:, None]
    i, j = np.nonzero(near)
    total = np.zeros(len(i))
    for x, y in zip(q.T, v.T, strict=True):
        total += (x[i] - y[j]) ** 2
    distance = np.sqrt(total)
    order = np.lexsort((ids[j], distance, i))
    i, j, distance = i[order], j[order], distance[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (distance[1:] != distance[:-1])
    start = np.flatnonzero(new)
    keep = np.arange(len(i)) - start[np.cumsum(new) - 1] < k if len(i) else new
    return query[i[keep]], ids[j[keep]], distance[keep]


def best(found: DataFrame, k: int, decimals: int = 9) -> DataFrame:
    order = Window.partitionBy("query").orderBy(rounded(F.col("distance"), decimals), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return np.maximum(0.0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :])
