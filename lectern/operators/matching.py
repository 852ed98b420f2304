"""The best match of each item among many documents, by shared terms, without the pairs that only frequent terms make.

Terms of an item are ordered from rare to frequent. The document that has most of its rarest terms gives a first overlap L, which
is verified. A document that shares L of the k terms of an item that occur at all misses at most k - L of them, so it has one of the first k - L + 1:
only those are joined, and what they find is verified on whole sets of terms. Where an item stands in a document, L is near k and
one or two rare terms are joined; the most frequent L - 1 terms of an item are never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.files import scratch

#: Rarest terms of an item that look for the first document.
PROBES = 4
#: Terms of all items up to which they are broadcast; beyond it, the terms of documents are dealt anew.
SMALL = 200_000


def best_overlap(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item, k, id, n): the document that shares most terms with each item, the smallest id of equal ones, and how many.

    ``items`` has item and terms, ``docs`` id and terms, arrays that may repeat. Items without terms, or of which no document has
    any, have no row; rows without an id, and null terms, take no part.
    """
    spark = items.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # terms are read five times, ranks twice
    held = kept(docs.where("id IS NOT NULL").select("id", F.array_compact(F.array_distinct("terms")).alias("terms")), "matching-terms")
    asked = items.select("item", F.explode(F.array_compact(F.array_distinct("terms"))).alias("term"))
    words = held.select("id", F.explode("terms").alias("term"))
    wanted = asked.select("term").distinct()
    frequency = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted, "term")
    by = Window.partitionBy("item")
    # terms that no document has would only come first and find nothing, so they are left out of the order
    ranked = asked.join(frequency, "term").select("item", "term", "df", F.row_number().over(by.orderBy("df", "term")).alias("place"), F.count(F.lit(1)).over(by).alias("found"))
    ranked = kept(ranked, "matching-ranks")

    small = ranked.count() <= SMALL

    def hits(terms: DataFrame) -> DataFrame:
        return words.join(F.broadcast(terms) if small else terms, "term").groupBy("item", "id").agg(F.count(F.lit(1)).alias("votes"))

    def verified(pairs: DataFrame) -> DataFrame:
        sets = items.select("item", F.array_compact(F.array_distinct("terms")).alias("asked"))
        whole = pairs.join(held, "id").join(sets, "item")
        return whole.select("item", F.size("asked").alias("k"), "id", F.size(F.array_intersect("asked", "terms")).alias("n"))

    first = hits(ranked.where(F.col("place") <= PROBES)).groupBy("item").agg(F.max(F.struct("votes", (-F.col("id")).alias("d"))).alias("m"))
    least = verified(first.select("item", (-F.col("m.d")).alias("id"))).select("item", F.col("n").alias("least"))
    prefix = ranked.join(least, "item").where(F.col("place") <= F.col("found") - F.col("least") + 1).select("item", "term")
    every = verified(hits(prefix).select("item", "id"))
    best = every.groupBy("item", "k").agg(F.max(F.struct("n", (-F.col("id")).alias("d"))).alias("best"))
    return best.select("item", "k", (-F.col("best.d")).alias("id"), F.col("best.n").alias("n"))
