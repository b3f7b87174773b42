"""A corpus from language identification to packed windows; each stage works on all that the one before kept.

language: null texts and texts without a letter go, a null lang is filled in with the nearest learned language; text in
an unlearned language stays. near_duplicates: one document (the smallest id) of
each group of linked ones stays. substrings: words of passages that an earlier document holds go; texts without any
stay as they are. secrets: secrets are replaced by their kinds. packing: pieces of windows, as in op2.
n_chars follows the text. Rows without doc_id, which no other row can be held against, pass the second and third stage.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelark.llm import jaccard, language, packing, secrets, substrings
from framelark.llm._common import prepare, shared_folder


def with_text(docs: DataFrame, text: F.Column) -> list[F.Column]:
    """docs' columns with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in docs.columns]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language.accepted(docs, language.labelled_sample(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.first_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return substrings.without_repeats(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = secrets.findings_by_path(rows, secrets.update_ledger(rows, secrets.new_ledger(prepare(spark))))
    return secrets.redact(found).select(with_text(docs, F.col("text")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", known_languages), ("near_duplicates", near_duplicates), ("substrings", without_repeats), ("secrets", without_secrets), ("packing", packed)]
#: Automata, suffix trees and a tokenizer are not SQL: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written as Parquet to the shared folder and read again."""
    docs, folder = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
