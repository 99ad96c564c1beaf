"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontam, divergence, exact_dedup, jaccard, licenses, line_dedup, mixing, passages, quality, secret_scan, sharding, sql, suffix_dedup, vector_codes,
)
from .tables import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def sharded(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    # Only the digest travels with the records; the operator itself carries any columns.
    docs = docs.select("doc_id", "text", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    return sharding.shard(docs).select(
        "doc_id", F.col("shard_bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.fuzzy_passages(documents(spark, folder))


def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, folder))


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(documents(spark, folder))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.leaks(documents(spark, folder), table(spark, folder, "benchmark")).drop("text_key")


def source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select("doc_id", "source", "mix_block", "mix_slot", "in_mix")


def license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(documents(spark, folder))


def line_deduplication(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_dedup.without_repeated_lines(documents(spark, folder).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.without_repeats(documents(spark, folder)).drop("kept")


def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder))


def exact_deduplication(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_copies(documents(spark, folder), carry=["doc_id"])


def vector_codes_of_all(spark: SparkSession, folder: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, folder, "embeddings"))
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    return vector_codes.label_errors(codes).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"),
    )


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, folder).select("doc_id", "text"))
    spans = F.col("secret_spans")
    return found.select(
        "doc_id",
        *[F.size(secret_scan.of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.listed(secret_scan.of_kind(spans, *secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"),
    )


QUERIES: dict[str, Query] = {
    "op1_sharding": sharded,
    "op2_substring_dedup": substring_dedup,
    "op3_ngram_jaccard_join": jaccard_join,
    "op4_quality_rules": quality_rules,
    "op5_license_scans": license_scans,
    "op6_benchmark_decontamination": decontamination,
    "op7_line_dedup": line_deduplication,
    "op8_source_mixing": source_mixing,
    "op9_secret_scans": secret_scans,
    "op10_suffix_array_dedup": suffix_array_dedup,
    "op11_source_divergence_audit": source_divergence,
    "op12_exact_dedup": exact_deduplication,
    "op13_vector_code_compression": vector_codes_of_all,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": sql.QUALITY,
    "op7_line_dedup": sql.LINES,
    "op9_secret_scans": sql.SECRETS,
    "op11_source_divergence_audit": sql.DIVERGENCE,
    "op12_exact_dedup": sql.COPIES,
    "op13_vector_code_compression": sql.CODES,
}
