"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing and packing, one after the other.

Each stage takes the documents that its predecessor kept and returns a DataFrame, which is written as Parquet and read again for the next one. Tables that a stage needs meanwhile, and the
output of a stage that the next one has read, are deleted as soon as they have served.

In every stage a null text is the empty one, ids may be null or repeated, columns other than doc_id, text, source and n_chars pass through whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from columnaut.llm import mixing, near_dedup, packing, quality, secrets
from columnaut.llm.common import documents, remove, scratch, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null and empty texts have too few words and go; repeated rows are judged alike; texts of any length are measured whole."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id; a row without an id stays only if no row of its group has one. Null and empty texts are one group, as are repeated rows;
    rows with one id and different texts are told apart by their texts."""
    return near_dedup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, those in encoded layers with their encoding. All rows stay, repeated ones too; a null text stays null; n_chars follows a text that changed."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often, and with as many of their words, as the mix takes them. Texts without a word are never taken; a null source is a source of its own; of rows that are alike in
    every column one bears the words of all; rows that share an id keep their own texts."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences, with a checksum of its token ids. A null or empty text is one piece, the end token; repeated rows are packed once
    per row; long texts are cut, so that only the first piece may be shorter than a sequence."""
    return packing.placements(docs, packing.tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: SQL can express neither the random draws of the mix nor the tokenizer; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None
