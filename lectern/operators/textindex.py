"""A positional inverted index as Parquet tables, and searches that read only the postings they need.

Documents are numbered in the order they are read; 1024 of them are a block (fewer, if they are long), named by its first number. A row of ``postings`` is one term in one block: which
documents have it (steps between their numbers), how often, at which word positions (steps again), and how long those documents
are. So no row grows with the table, however common a term is. ``blocks`` has for each such row how many documents it holds and the
largest BM25 part that any of them has: the block maximum. Both are sorted by term, so a search for a few terms skips row groups.

Searches take tables of queries, not one query at a time: (query, field, term, weight) for ranks, (query, field, words) for
phrases. Boolean trees are built from ``term``, ``phrase``, ``all_of``, ``any_of`` and ``but_not``.

Defined cases: a null or empty text has no words, and its document is found by none; null ids are documents; terms that no document
has match nothing; equal scores (to six decimals) are ranked by id, nulls last; an empty table gives an empty index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.sources.files import scratch

#: Documents of a block, as a power of two.
BLOCK_BITS = 10
WORD = re.compile(r"[^\W_]+")
#: How BM25 weighs term frequency and length.
K1, B = 1.2, 0.75
#: Blocks that a ranked search reads of each query before it knows a bound.
FIRST_BLOCKS = 2
#: Scores are ranked as rounded to this many decimals; bounds are widened by more than the rounding.
DECIMALS, SLACK = 6, 1e-5
#: A place is a document of the block and a word, put together in one number.
PLACE_BITS = 40

#: Characters after which a block ends before it has all its documents.
BLOCK_CHARS = 1 << 23

POSTING = "key string, block long, docs array<int>, ids array<long>, tfs array<int>, lens array<int>, places array<array<int>>"


def part(tf, size, mean):
    """What a term adds to a document's score, before its rarity: for numbers, arrays and columns alike."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_postings(docs: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Posting rows of one block of documents (number, id, texts): one for each term, and for each field one without a term, which
    has the ids and lengths of all documents."""
    block, n = docs[0][0], len(docs)
    lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
    for at, name in enumerate(names, 2):
        words = [WORD.findall(d[at] or "") for d in docs]
        lens = np.array([len(w) for w in words], np.int32)
        terms = pa.array(list(chain.from_iterable(words)), pa.string()).dictionary_encode()
        code = terms.indices.to_numpy(zero_copy_only=False)
        total = len(code)
        order = np.argsort(code, kind="stable")  # by term, then in the order of the text
        code, doc = code[order], np.repeat(np.arange(n, dtype=np.int32), lens)[order]
        place = (np.arange(total) - np.repeat(np.cumsum(lens) - lens, lens))[order].astype(np.int32)
        term = np.ones(total, bool)
        term[1:] = code[1:] != code[:-1]
        new = term.copy()
        new[1:] |= doc[1:] != doc[:-1]
        steps = place.copy()
        steps[1:] -= np.where(new[1:], 0, place[:-1])
        first = np.flatnonzero(new)  # of each document of each term
        begin = np.flatnonzero(term[first])
        gaps = doc[first].copy()
        gaps[1:] -= np.where(term[first][1:], 0, doc[first][:-1])
        # the row without a term comes first
        counts = np.diff(np.append(begin, len(first)))
        ends = np.concatenate([[0, n], n + np.cumsum(counts)])
        keys = pa.concat_arrays([pa.array([""]), terms.dictionary.take(pa.array(code[first][begin]))])
        head = np.diff(np.arange(n, dtype=np.int32), prepend=0).astype(np.int32)
        places = lists(np.concatenate([np.zeros(n, np.int64), np.append(first, total)]), pa.array(steps))
        ids = pa.concat_arrays([lists([0, n], pa.array([d[1] for d in docs], pa.int64())), pa.nulls(len(keys) - 1, pa.list_(pa.int64()))])
        columns = [
            pc.binary_join_element_wise(pa.scalar(name), keys, ":"), pa.array(np.full(len(keys), block)), lists(ends, pa.array(np.concatenate([head, gaps]))), ids,
            lists(ends, pa.array(np.concatenate([np.zeros(n, np.int32), np.diff(np.append(first, total)).astype(np.int32)]))), lists(ends, pa.array(np.concatenate([lens, lens[doc[first]]]))), lists(ends, places),
        ]
        whole = pa.RecordBatch.from_arrays(columns, ["key", "block", "docs", "ids", "tfs", "lens", "places"])
        for a in range(0, len(whole), 20_000):
            yield whole.slice(a, 20_000)


class TextIndex:
    """Three tables below one path: postings, blocks and fields."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.blocks, self.fields = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "blocks", "fields"))

    @classmethod
    def build(cls, docs: DataFrame, columns: dict[str, str], id_column: str, path: str | None = None) -> TextIndex:
        """Index the ``columns`` (field name: column) of ``docs``. Texts are read once, and nothing is shuffled."""
        spark, names = docs.sparkSession, list(columns)
        path = path or scratch(docs.sparkSession, "text-index")

        size = 1 << BLOCK_BITS

        def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            chars = 0
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (len(held) == size or chars > BLOCK_CHARS):
                        yield from block_postings(held, names)
                        held, chars = [], 0
                    held.append(row)
                    chars += sum(len(x or "") for x in row[2:])
            if held:
                yield from block_postings(held, names)

        # a block's documents stand in one task, so its postings are made there and only sorted
        numbered = docs.select(F.monotonically_increasing_id().alias("no"), F.col(id_column).cast("long").alias("id"), *[F.lower(F.col(c)).alias(n) for n, c in columns.items()])
        rows = numbered.mapInArrow(tokenise, POSTING)
        postings = written(rows.sortWithinPartitions("key", "block"), f"{path}/postings")
        headers = postings.where(F.endswith("key", F.lit(":"))).select(F.expr("left(key, length(key) - 1)").alias("field"), F.explode("lens").alias("len"))
        fields = written(headers.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("mean")), f"{path}/fields")
        of_field = postings.where(~F.endswith("key", F.lit(":"))).select("key", "block", F.substring_index("key", ":", 1).alias("field"), "tfs", "lens")
        most = F.array_max(F.transform(F.arrays_zip("tfs", "lens"), lambda x: part(x["tfs"].cast("double"), x["lens"], F.col("mean"))))
        blocks = of_field.join(F.broadcast(fields), "field").select("key", "block", F.size("tfs").alias("n"), most.alias("bound"))  # as many fields as ``columns`` names
        written(blocks.sortWithinPartitions("key", "block"), f"{path}/blocks")
        return cls(spark, path)

    # ranks

    def weighted(self, queries: DataFrame) -> DataFrame:
        """(query, key, field, factor): each query's terms with weight times rarity."""
        q = queries.select("query", F.concat_ws(":", "field", F.lower("term")).alias("key"), "field", "weight").groupBy("query", "key", "field").agg(F.sum("weight").alias("weight"))
        counts = self.blocks.join(q.select("key").distinct(), "key").groupBy("key").agg(F.sum("n").alias("df"))
        rarity = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return q.join(counts, "key").join(F.broadcast(self.fields), "field").select("query", "key", "field", "mean", (F.col("weight") * rarity).alias("factor"))

    def waves(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The (query, block) pairs that a search for the best ``k`` reads first and then, and the scores of the first ones.

        A block's documents can't score more than the sum of its maxima, so what is below the k-th score so far is not read.
        """
        terms = written(self.weighted(queries), scratch(self.spark, "search-terms"))
        bounds = terms.join(self.blocks, "key").groupBy("query", "block").agg(F.sum(F.col("factor") * F.col("bound")).alias("most"))
        order = Window.partitionBy("query").orderBy(F.desc("most"), "block")
        bounds = written(bounds.withColumn("nth", F.row_number().over(order)), scratch(self.spark, "search-bounds"))
        first = bounds.where(F.col("nth") <= FIRST_BLOCKS)
        got = written(self.scores(terms, first), scratch(self.spark, "search-scores"))
        ranked = got.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"))))
        floor = ranked.where(F.col("nth") == k).select("query", F.col("score").alias("floor"))
        then = bounds.where(F.col("nth") > FIRST_BLOCKS).join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("most") + SLACK >= F.col("floor")))
        return first.select("query", "block"), written(then.select("query", "block"), scratch(self.spark, "search-wanted")), got.unionByName(self.scores(terms, then.select("query", "block")))

    def scores(self, terms: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query, block, doc, score) of all documents of the pairs' blocks that have one of the query's terms."""

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = batch.column("docs").value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                tf, size = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("tfs", "lens"))
                factor, mean = (batch.column(c).to_numpy()[row] for c in ("factor", "mean"))
                yield pa.RecordBatch.from_arrays([batch.column("query").take(pa.array(row)), batch.column("block").take(pa.array(row)), pa.array(unstepped(batch.column("docs"))), pa.array(factor * part(tf, size, mean))], ["query", "block", "doc", "score"])

        met = terms.join(pairs.select("query", "block"), "query").join(self.postings.select("key", "block", "docs", "tfs", "lens"), ["key", "block"])
        parts = met.select("query", "block", "docs", "tfs", "lens", "factor", "mean").mapInArrow(scored, "query long, block long, doc int, score double")
        return parts.groupBy("query", "block", "doc").agg(F.sum("score").alias("score"))

    def ranked(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, rank, id, score): the best ``k`` documents of each query (query long, field, term, weight)."""
        *_, scores = self.waves(queries, k)
        rounded = scores.withColumn("score", F.round("score", DECIMALS))
        # ties go by id, so those with the k-th score are named before they are cut
        near = rounded.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("place") <= k)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        return self.named(near).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")

    def named(self, found: DataFrame) -> DataFrame:
        """``found`` (block, doc) with the documents' ids."""
        first = self.fields.agg(F.min("field")).first()[0]
        heads = self.postings.where(F.col("key") == f"{first}:").select("block", "ids")
        return found.join(heads, "block").withColumn("id", F.col("ids")[F.col("doc")]).drop("ids")

    # phrases and boolean trees

    def places(self, phrases: DataFrame) -> DataFrame:
        """(query, block, starts): where the words of (query, field, words) stand in a row, as numbers of document and word.

        Only blocks that have all words of a phrase are read; their lists are moved by the word's place and intersected.
        """
        words = phrases.where(F.size("words") > 0).select("query", "field", F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
        keys = words.select("query", "n", "i", F.concat_ws(":", "field", F.lower("word")).alias("key"))
        whole = keys.join(self.blocks.select("key", "block"), "key").groupBy("query", "n", "block").agg(F.count(F.lit(1)).alias("met")).where("met = n")

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc, i = unstepped(batch.column("docs")), batch.column("i").to_numpy()
                inner = batch.column("places").flatten()
                per_doc = inner.value_lengths().to_numpy(zero_copy_only=False)
                at = unstepped(inner).astype(np.int64)
                doc_row = np.repeat(np.arange(len(batch)), batch.column("docs").value_lengths().to_numpy(zero_copy_only=False))
                spot = (np.repeat(doc, per_doc).astype(np.int64) << PLACE_BITS) + at - np.repeat(i[doc_row], per_doc)
                row = np.repeat(doc_row, per_doc)
                ok = at >= np.repeat(i[doc_row], per_doc)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[ok], minlength=len(batch)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("n"), batch.column("block"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(spot[ok]))], ["query", "n", "block", "spots"])

        met = keys.join(whole.select("query", "block"), "query").join(self.postings.select("key", "block", "docs", "places"), ["key", "block"])
        lists = met.select("query", "n", "block", "i", "docs", "places").mapInArrow(moved, "query long, n int, block long, spots array<long>")
        both = lists.groupBy("query", "n", "block").agg(F.collect_list("spots").alias("x")).where("size(x) = n")
        common = F.aggregate(F.slice("x", 2, F.size("x")), F.col("x")[0], F.array_intersect)
        return both.select("query", "block", F.array_sort(common).alias("starts")).where(F.size("starts") > 0)

    def phrases(self, queries: DataFrame) -> DataFrame:
        """(query, id, n): documents that hold a phrase (query long, field, words), and how often."""
        each = self.places(queries).select("query", "block", F.explode("starts").alias("start"))
        counted = each.groupBy("query", "block", F.shiftright("start", PLACE_BITS).cast("int").alias("doc")).agg(F.count(F.lit(1)).alias("n"))
        return self.named(counted).select("query", "id", "n")

    def matching(self, trees: dict[int, Node]) -> DataFrame:
        """(query, id): documents that satisfy the boolean trees, block by block from sorted lists of document numbers."""
        leaves = [leaf for tree in trees.values() for leaf in tree.leaves()]
        number = {leaf: i for i, leaf in enumerate(dict.fromkeys(leaves))}
        rows = [(i, leaf.field, list(leaf.words)) for leaf, i in number.items()]
        asked = self.spark.createDataFrame(rows, "query long, field string, words array<string>")
        docs = F.array_distinct(F.transform("starts", lambda s: F.shiftright(s, PLACE_BITS).cast("int")))
        lists = self.places(asked).select("block", "query", docs.alias("docs"))
        by_block = lists.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query", "docs"))).alias("lists"))
        none = F.array().cast("array<int>")
        found = [F.struct(F.lit(q).cast("long").alias("query"), tree.column(lambda leaf: F.coalesce(F.col("lists")[F.lit(number[leaf]).cast("long")], none)).alias("docs")) for q, tree in trees.items()]
        each = by_block.select("block", F.explode(F.array(*found)).alias("x")).select("block", "x.query", F.explode("x.docs").alias("doc"))
        return self.named(each).select("query", "id")


def unstepped(col: pa.Array) -> np.ndarray:
    """Sums of the steps of each list, one after the other: lists of steps as what they stand for."""
    steps = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(steps)
    begin = np.cumsum(sizes) - sizes
    before = np.where(begin > 0, np.concatenate([[0], total])[begin], 0)
    return (total - np.repeat(before, sizes)).astype(np.int32)


@dataclass(frozen=True)
class Node:
    """A part of a boolean tree: a phrase (of one word or more), or an operation on parts."""

    kind: str
    field: str = ""
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()

    def leaves(self) -> list[Node]:
        return [self] if self.kind == "phrase" else [x for p in self.parts for x in p.leaves()]

    def column(self, of) -> Column:
        if self.kind == "phrase":
            return of(self)
        first, *rest = [p.column(of) for p in self.parts]
        for other in rest:
            first = {"all": F.array_intersect, "any": F.array_union, "not": F.array_except}[self.kind](first, other)
        return first


def phrase(words: str, field: str = "text") -> Node:
    return Node("phrase", field, tuple(WORD.findall(words.lower())))


term = phrase


def all_of(*parts: Node) -> Node:
    return Node("all", parts=parts)


def any_of(*parts: Node) -> Node:
    return Node("any", parts=parts)


def but_not(wanted: Node, unwanted: Node) -> Node:
    return Node("not", parts=(wanted, unwanted))
