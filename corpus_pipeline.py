"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again for the next one.

Defined cases, in every stage: rows are told apart by id and text, never by id alone; a null or empty text is a document
without words; a null doc_id is a document like others, last in ties; very long texts are read whole; an empty table gives an
empty table; all columns of documents, whatever their names, pass through all stages but the last. Tests compare each stage
with plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import exact_dedup, minhash, packing, secret_scan, toxicity
from lectern.llm.common import materialize


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled rows of this stage's input.

    Null and empty texts have no evidence and stay; repeated rows share their score; without labels of both classes all stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest text, then the smallest doc_id (nulls last), then one of equal rows.

    Null, empty and white-space-only texts are one group.
    """
    return exact_dedup.drop_duplicates(docs)


def distinguishable(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the smallest doc_id (nulls last), then one of equal rows.

    Texts without words are linked with nothing and stay.
    """
    return minhash.drop_near_duplicates(docs)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in place; every row stays, null texts as they are; n_chars follows the new text.

    Overlapping findings are one mark; equal texts are scanned once.
    """
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces with their sequence and offset; a null or empty text is a piece of the end id alone.

    Texts of over 2048 tokens are cut; equal lengths are ranked by id, piece and content.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", clean),
    ("exact_dedup", distinct),
    ("near_dedup", distinguishable),
    ("secret_scan", redacted),
    ("packing", packed),
]

#: SQL can't express the toxicity model, MinHash's shingle links or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
