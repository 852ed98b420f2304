"""Places in texts that stand near each other: a join by bins of the position, not by pairs of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pieces(docs: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, start, stop, piece): what stands between spaces in each text, with its code points from 0.

    Rows are told apart, also where ids repeat; a running sum over one text's pieces gives the positions.
    """
    named = docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.split(F.coalesce(column, F.lit("")), " ").alias("pieces"))
    rows = named.select("id", "row", F.posexplode("pieces").alias("nth", "piece"))
    upto = Window.partitionBy("id", "row").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece") + 1).over(upto), F.lit(0)).cast("long")
    return rows.select("id", "row", "piece", start.alias("start")).withColumn("stop", F.col("start") + F.length("piece")).where("piece <> ''")


def within_reach(left: DataFrame, right: DataFrame, reach: int, keys: list[str]) -> DataFrame:
    """Pairs with equal ``keys`` where [right.start, right.stop) lies in [left.start - reach, left.stop + reach).

    ``left`` goes to the bins that its window meets (two, or one more for each bin's width of a long span), ``right`` to the bin
    where it starts, so a pair meets once, and a bin of a text holds no more rows than start in it.
    """
    width = 2 * reach + 64
    a = left.select(*keys, F.struct(*[left[c] for c in left.columns if c not in keys]).alias("a"), F.greatest(F.col("start") - reach, F.lit(0)).alias("lo"), (F.col("stop") + reach).alias("hi"))
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    b = right.select(*keys, F.struct(*[right[c] for c in right.columns if c not in keys]).alias("b"), F.floor(F.col("start") / width).alias("bin"))
    return a.join(b, [*keys, "bin"]).where("b.start >= lo AND b.stop <= hi").select(*keys, "a", "b")


def mapped(docs: DataFrame, author: Column, affiliation: Column, reach: int = 250) -> DataFrame:
    """(id, author, affiliations): what stands within ``reach`` characters of the first place of each author.

    ``author`` and ``affiliation`` are conditions on the column ``piece``.
    """
    every = pieces(docs)
    # a piece is an author only where it stands first
    first = every.where(author).groupBy("id", "row", "piece").agg(F.min(F.struct("start", "stop")).alias("x")).select("id", "row", "piece", "x.start", "x.stop")
    near = within_reach(first, every.where(affiliation), reach, ["id", "row"])
    return near.groupBy("id", "row", F.col("a.piece").alias("author")).agg(F.array_join(F.array_sort(F.collect_set("b.piece")), ",").alias("affiliations")).drop("row")
