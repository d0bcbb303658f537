"""A training-corpus pipeline in five stages, each an operator of qiyas.llm.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has
kept, and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

1. quality classifier: documents whose score is below the threshold go; the label sample is
   fitted on the labels of sf_dir and the texts of docs.
2. line dedup: lines that an earlier line equals or nearly equals go; a document goes if
   nothing but white space is left of a text that had more.
3. n-gram Jaccard join: of each component of linked documents one stays, the least by doc_id
   (null ids last), set and hash of the text, and all documents without words.
4. secret scans: live secrets are replaced by a mark; no document goes.
5. best-fit packing: one row for each piece of a document, with its sequence and offset.

Each row is judged by its own text in stage 1. Rows of equal doc_id and text share their fate in stage 3; of
rows without an id that are equal in text, it keeps one. Null texts stay null up to the
last stage, where they are empty. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qiyas.llm import jaccard_join, line_dedup, packing, quality, secrets
from qiyas.llm.queries import BATCH_ROWS
from qiyas.llm.scratch import Scratch, free_name


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return quality.kept(docs, quality.fitted(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    counts = free_name("n_lines", docs.columns), free_name("n_removed", docs.columns)
    after = line_dedup.deduplicated(docs, counts)
    emptied = (F.col(counts[1]) > 0) & ~F.col("text").rlike(r"\S")
    return after.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return jaccard_join.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return packing.packed(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: A latent-semantic model and BPE ids can't be had in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents of sf_dir."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
