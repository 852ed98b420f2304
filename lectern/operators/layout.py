"""Ordered elements of documents: gaps and islands, heading trees, reading order, columns and margins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.relational import settled_rows


def islands(df: DataFrame, keys: list[str], order: list[str], apart: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows that are not ``apart`` from the row before; ``apart`` may use lag over the same order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_cut", F.when(apart, 1).otherwise(0)).withColumn(name, F.sum("_cut").over(w)).drop("_cut")


def before(column: str, keys: list[str], order: list[str], default=None) -> Column:
    return F.lag(column, 1, default).over(Window.partitionBy(*keys).orderBy(*order))


def text_lines(words: DataFrame, gap: float = 5.0) -> DataFrame:
    """Words (page, ord, x0, x1, y, text) joined to lines where y changes by no more than ``gap``."""
    keys, order = ["page"], ["ord"]
    far = F.abs(F.col("y") - before("y", keys, order)) > gap
    grouped = islands(words, keys, order, F.coalesce(far, F.lit(False)), "line").groupBy("page", "line")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return grouped.agg(joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y"))


def merged(elements: DataFrame, dy: float = 5.0, dx: float = 10.0, dsize: float = 2.0) -> DataFrame:
    """Neighbouring elements (page, ord, x0, x1, y, size, text) that are close in place and font size become one."""
    keys, order = ["page"], ["ord"]
    prior = lambda c: before(c, keys, order)
    apart = (F.abs(F.col("y") - prior("y")) > dy) | (F.col("x0") - prior("x1") > dx) | (F.abs(F.col("size") - prior("size")) > dsize)
    grouped = islands(elements, keys, order, F.coalesce(apart, F.lit(False)), "block").groupBy("page", "block")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return grouped.agg(joined.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg("size").alias("size"))


def parents(headings: DataFrame, key: str, order: str, level: str, id_: str, deepest: int = 6) -> DataFrame:
    """Adds ``parent``: the latest earlier heading of the nearest smaller level."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = headings.withColumns({f"_l{n}": F.last(F.when(F.col(level) == n, F.struct(F.col(order).alias("o"), F.col(id_).alias("id"))), ignorenulls=True).over(w) for n in range(1, deepest + 1)})
    above = F.array_max(F.array_compact(F.array(*[F.when(F.col(level) > n, F.col(f"_l{n}")) for n in range(1, deepest + 1)])))
    return seen.withColumn("parent", above["id"]).drop(*[f"_l{n}" for n in range(1, deepest + 1)])


def skipped_levels(headings: DataFrame, key: str, order: str, level: str) -> DataFrame:
    """Headings that are more than one level below the one before; the first may be of level 1."""
    return headings.withColumn("_before", before(level, [key], [order], 0)).where(F.col(level) > F.col("_before") + 1).drop("_before")


def columns_of(elements: DataFrame, width: float, share: float = 0.05) -> DataFrame:
    """(page, n_columns, split): two columns if the largest gap between sorted left edges exceeds a share of the width."""
    w = Window.partitionBy("page").orderBy("x0")
    gaps = elements.withColumn("_b", F.lag("x0").over(w)).withColumn("gap", F.col("x0") - F.col("_b")).withColumn("mid", (F.col("x0") + F.col("_b")) / 2)
    best = F.max(F.struct("gap", "mid"))
    return gaps.groupBy("page").agg(best.alias("b")).select("page", F.when(F.col("b.gap") > share * width, 2).otherwise(1).alias("n_columns"), F.when(F.col("b.gap") > share * width, F.col("b.mid")).alias("split"))


def reading_order(elements: DataFrame, columns: DataFrame) -> DataFrame:
    """Adds ``place``: column by column from the left, from top to bottom (y grows upwards)."""
    side = F.when(F.col("split").isNotNull() & (F.col("x0") >= F.col("split")), 1).otherwise(0)
    both = elements.join(columns, "page", "left").withColumn("column", side)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("column", F.desc("y"), "x0"))).drop("n_columns", "split")


def margins(elements: DataFrame, width: float, height: float) -> DataFrame:
    return elements.groupBy("page").agg(F.min("x0").alias("left"), (F.lit(width) - F.max("x1")).alias("right"), F.min("y").alias("bottom"), (F.lit(height) - F.max("y")).alias("top"))


def dependency_levels(tasks: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(task, level): 0 without dependencies, else one more than the highest of them; tasks in or behind a cycle are left out.

    ``edges`` has task and needs. Each round settles the tasks all of whose needs are settled, until there are none.
    ``most`` is a bound on the level for callers who know one: higher levels raise, and nothing is left out.
    """
    settled = settled_rows(tasks.join(edges.select("task").distinct(), "task", "left_anti").select("task", F.lit(0).alias("level")))
    open_ = edges.select("task", "needs").distinct()
    for level in count(1):
        waiting = open_.join(settled.select(F.col("task").alias("needs"), F.lit(1).alias("ok")), "needs", "left")
        done = waiting.groupBy("task").agg(F.count_if(F.col("ok").isNull()).alias("missing")).where("missing = 0").select("task")
        ready = settled_rows(done.join(settled.select("task"), "task", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return settled
        if most is not None and level > most:
            raise ValueError(f"the tasks have more than {most} levels")
        settled = settled.unionByName(ready)
