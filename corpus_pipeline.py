"""Corpus pipeline: language ID, exact dedup, near dedup, mixing, BPE coding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What an
operator decides is decided for rows, not ids: rows without an id or that repeat one are documents of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import bpe, exact_dedup, langid, mixing, ngram_join
from factweave.llm.common import free_name, remove, shared_dir, table, with_row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (also null and empty texts) go. A missing lang is filled in."""
    return langid.keep_identified(docs, langid.train(docs, F.lit(True)))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, of these the one with the smallest id, an id before none.
    Null, empty and blank texts are one group; an empty table stays empty."""
    row = free_name(docs, "row")
    rows = with_row(docs, name=row)
    kept = exact_dedup.exact_dedup(rows, id_col=row).filter("kept").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id (an id before none), of each group linked by 5-word shingles. Null, empty
    and blank texts are linked with nothing and stay."""
    row = free_name(docs, "row")
    rows = with_row(docs, name=row)
    kept = ngram_join.ngram_join(rows, id_col=row).filter("component_id = doc_id").select(F.col("doc_id").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times; texts without a word are not taken. The null
    source is a source of its own; ties go by a hash of the row's number."""
    row, copies = free_name(docs, "row"), free_name(docs, "copies")
    rows = with_row(docs, name=row)
    taken = mixing.mix(rows, id_col=row).filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies))
    return rows.join(taken, row).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_decode(docs, bpe.default_path()).select(
        "doc_id",
        "ids",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("mix_sources", mixed),
    ("bpe_coding", coded),
]

#: The stages are not expressible in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's table is removed once that of the stage after it is written; the result reads
    the last one, so that one stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(spark, before)
            before = path
    return docs
