"""From documents to token ids: quality rules, near-duplicates, secrets, source mix, SentencePiece.

Every stage works on all that the one before kept, and all but the last return the columns of ``documents``.

Defined cases, of every stage. Null or empty texts: quality_rules rejects them, having no words; a later stage that is given some keeps one of those without an id apart from those with
one (near-duplicates), finds no secrets, gives them size 0 in the mix, where they are drawn like others, and no ids. Null ids: rows of their own, never labelled and never duplicates. Null sources: one source,
the last. Null in other columns: carried along. Very long texts: one pass each. Ties and repeated rows: near-duplicates keep one row with the least id; the mix emits repeated rows as
rows of their own. Empty tables: empty results with the same columns. Extra columns, whatever their names: carried along up to the last stage, which gives doc_id, n_tokens and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkbrook.llm import mixing, near_copies, quality, secrets, subwords
from sparkbrook.llm.common import read, written
from sparkbrook.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_copies.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix, each as often as it was emitted."""
    return mixing.mix(docs)


def sentencepiece_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document of the mix."""
    return subwords.encode_documents(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("sentencepiece_encode", sentencepiece_encode),
]

#: SQL can't express the forest, the fingerprints and the merges; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
