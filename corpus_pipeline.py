"""Corpus pipeline: from the raw ``documents`` table to token ids.

Each stage calls one operator of ``sitelens.llm`` on all that its predecessor kept.  Every
stage's result is written as Parquet in the shared folder and read again as
the next stage's documents, so a lost executor costs one stage's tasks at most.

1. quality classifier: documents scored below the threshold go;
2. n-gram Jaccard join: of each class of similar documents the one with the smallest doc_id stays;
3. suffix-array dedup: repeats of 400 bytes are cut out of the texts (characters cut in part stay), n_chars is counted anew;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece encoding: two sampled segmentations of each text, with inclusion scores.

Stages 1 to 4 return the columns of ``documents``; rows whose text becomes empty in stage 3 stay, with an empty text.
They work on rows: one with a NULL or repeated doc_id is a document of its own, and of similar rows with one doc_id the first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm import decontaminate, jaccard_join, quality, segmentations, suffix_dedup
from sitelens.llm.common import CHUNK_BYTES, ROW, narrow, staged, stamped, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = stamped(docs)
    classes = jaccard_join.similar_documents(narrow(rows, ROW))
    gone = classes.filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"))
    return rows.join(gone, rows[ROW] == F.col("gone_id"), "left_anti").drop(ROW)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, _ = stamped(docs)
    kept = suffix_dedup.suffix_dedup(narrow(rows, ROW), whole_characters=True).select(F.col("doc_id").alias("kept_id"), F.decode("kept", "UTF-8").alias("kept_text"))
    joined = rows.drop("text", "n_chars").join(kept, rows[ROW] == F.col("kept_id"))
    return joined.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return segmentations.encode(docs, chunk_bytes=2 * CHUNK_BYTES)  # beside what earlier stages left in the workers


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_class),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding", token_ids),
]

ORACLE_SQL = None  # no stage but the cuts themselves can be said in SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; returns the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
