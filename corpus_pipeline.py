"""A corpus from raw documents: quality, repeated lines, near duplicates, source weights, token ids."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardlake.llm import common, linededup, mixing, nearcopies, quality, sentencepiece


def _good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at 0.5 or more."""
    model = quality.learn(docs, common.table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("quality_score >= 0.5").select(docs.columns)


def _own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one keeps; n_chars follows the text."""
    kept = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with similarity 0.8 or more by five words, that of the smallest doc_id.

    They meet by SimHash, and by bands beyond its reach.
    """
    return nearcopies.keep_one(docs)


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that a mix at the source weights takes, a row for each document and epoch."""
    return mixing.mixed_documents(docs, mixing.mix_sources(docs))


def _ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    both = sentencepiece.encode(docs, decoded="decoded")
    return both.select(*(c for c in docs.columns if c != "text"), "ids", F.size("ids").cast("long").alias("n_ids"), F.coalesce(F.col("decoded") == F.col("text"), F.lit(True)).alias("round_trip"))


STAGES = [
    ("quality classifier", _good),
    ("line dedup", _own_lines),
    ("SimHash near-dedup", _distinct),
    ("mixing sources to target weights", _mixed),
    ("SentencePiece encoding and decoding", _ids),
]

#: Learned scores, fingerprints and merged pieces have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Take a folder away by the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again.

    A stage's table is taken away as soon as the next one's is written; the last stays for the caller.
    """
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _delete(spark, f"{folder}/{k - 1}")
    return docs
