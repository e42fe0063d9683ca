"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, langid, licenses, line_dedup, mixing, ngram_join, quality, suffix_dedup
from .common import table


def op1_suffix_dedup(spark, sf_dir):
    rows = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_bpe_coding(spark, sf_dir):
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), bpe.default_path())
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_order_minhash(spark, sf_dir):
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark, sf_dir):
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_mix_sources(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.crc_bucket(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.train(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    predicted = F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted)


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_bpe_coding": op4_bpe_coding,
    "op5_order_minhash": op5_order_minhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
}

ORACLE = {
    "op2_license_scan": licenses.oracle(),
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
}
