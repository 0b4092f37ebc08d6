"""Queries of the corpus operators: opN_<name> applies operator N with production settings to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixity, mixing, piecewise, quality, secrets, simhash, subwords, token_counts, token_files, url_filter
from .common import read


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op2_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive, audited against a replica with faults planted by rule."""
    pages = read(spark, sf_dir, "pages")
    return fixity.audit(fixity.records(pages), fixity.records(fixity.planted_replica(pages)))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op4_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.fingerprint_documents(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op8_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with merge-dropout and decoded again."""
    return subwords.round_trip(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.fresh_folder(spark)
    token_files.write_tokens(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), folder, end_id=2)
    return token_files.token_digest(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_fixity_audit": fixity.FIXITY_SQL, "op3_source_mix": mixing.MIX_SQL, "op7_url_filter": url_filter.URL_SQL}
