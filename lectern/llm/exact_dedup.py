"""Exact dedup: a persistent digest index, bucketed and sorted by digest, to which new digests are appended.

Texts are equal when they are identical after deleting the six ASCII white-space characters. The index is a bucketed
table (digest, keep_id, n_points, batch); a batch of new rows is reduced to one row for each digest by partial
aggregation, sort-merge anti-joined with the index (its buckets are read as they lie, without a shuffle) and appended.
A digest that the index has keeps its first owner. ``ingest`` feeds a table in batches of falling text length, so that the
first owner is the row that has to stay: the longest original text, then the smallest doc_id. An index that the caller made lives on
in the catalog and takes later tables; one of the call's own is dropped once the answer is written. Only digests and ids move
between machines, never texts. Everything is DataFrame code; no Python runs on executors.

Defined cases: a null text counts as empty; empty and white-space-only texts are equal to each other; very long texts are
one digest like others; rows with a null doc_id take part, come after all others in ties and keep a null keep_id if the
whole group has none; repeated rows with the same doc_id and text count as members each and get the same answer, and one of
them stays in ``drop_duplicates``; an empty table gives an empty result; further columns, whatever their names, are ignored
by ``fingerprints`` and kept by ``drop_duplicates``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import boxed, join_by_key, materialize

#: The white-space characters that the comparison ignores.
WHITE_SPACE = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
#: Batches of falling text length in which a table is fed to the index.
BATCHES = 2


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITE_SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_points): one narrow row for each document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"),
        F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_points"),
    )


def groups(prints: DataFrame) -> DataFrame:
    """(digest, keep_id, n_points, copies, group_size): the longest original text stays, then the smallest doc_id.

    ``copies`` is how many rows have the doc_id and length of the row that stays.
    """
    members = prints.groupBy("digest", "doc_id", "n_points").agg(F.count(F.lit(1)).alias("copies"))
    rank = F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "copies")
    best = members.groupBy("digest").agg(F.min(rank).alias("best"), F.sum("copies").alias("group_size"))
    return best.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("n_points"), F.col("best.copies").alias("copies"), "group_size")


class DigestIndex:
    """A table of all digests seen so far, bucketed and sorted by digest; it persists under its name, if it has one."""

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if table and self.exists():  # a table keeps the number of buckets it was made with
            self.buckets = int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def append(self, new: DataFrame) -> None:
        """Add the groups whose digest the index lacks; a digest that it has keeps its first owner."""
        fresh = new.select("digest", "keep_id", "n_points", "copies")
        if self.exists():
            fresh = fresh.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        fresh.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def owners(self, prints: DataFrame) -> DataFrame:
        """(digest, keep_id, copies, group_size) for every digest of ``prints``, as the index has it; sizes are those of ``prints``."""
        sizes = prints.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        return sizes.join(self.read().select("digest", "keep_id", "copies"), "digest")

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Fold documents into the index; returns their fingerprints."""
        prints = materialize(fingerprints(docs), "digests")
        self.fold(prints)
        return prints

    def fold(self, prints: DataFrame, batches: int = BATCHES) -> None:
        """Add fingerprints, the longest texts first, each batch against what the earlier ones brought."""
        cuts = sorted(set(prints.approxQuantile("n_points", [k / batches for k in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
        upper = None
        for cut in [*cuts, None]:
            batch = prints
            if upper is not None:
                batch = batch.where(F.col("n_points") < upper)
            if cut is not None:
                batch = batch.where(F.col("n_points") >= cut)
            self.append(groups(batch))
            upper = cut


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier tables, keep_id may be a row of one of them; group_size counts rows of ``docs``.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    prints = index.ingest(docs)
    out = join_by_key(prints, index.owners(prints), "digest", "group_size", prints.count())
    out = out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    if not own:
        return out
    out = materialize(out, "exact-duplicates")
    index.drop()
    return out


def drop_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group that the index has not seen before.

    The row that stays is found by its id, length and digest. Where several rows have them all, one of these is taken, by
    partial aggregation, so that no group of copies meets in one task; the others are joined without it.
    """
    given = index is not None
    index = index or DigestIndex(docs.sparkSession)
    prints = materialize(fingerprints(docs), "digests")
    fresh = groups(prints)
    if given and index.exists():
        fresh = materialize(fresh.join(index.read().select("digest"), "digest", "left_anti"), "new-digests")
    index.fold(prints)
    if not given:  # every digest of an index of its own is new, and the index has its owner
        fresh = materialize(index.read(), "new-digests")
        index.drop()
    keep = fresh.select(F.col("keep_id").alias("doc_id"), "digest", "n_points", F.lit(True).alias("found"), "copies")
    rows = boxed(docs).select("row", "doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"), F.char_length("text").cast("long").alias("n_points"))
    same = lambda k: rows["doc_id"].eqNullSafe(k["doc_id"]) & (rows["digest"] == k["digest"]) & (rows["n_points"] == k["n_points"])
    once, often = keep.where("copies = 1"), keep.where("copies > 1")
    single = rows.join(once.hint("merge"), same(once), "left_semi").select("row")
    several = rows.join(often, same(often), "left_semi").groupBy("digest").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(several).select("row.*")
