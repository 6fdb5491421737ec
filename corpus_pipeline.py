"""A training corpus from raw documents: five stages, each one of the operators of ``evispark.llm``.

1. quality_rules: lines that break a rule go, and documents that are rejected go.
2. near_dedup: one document, the one with the smallest doc_id, stays of each group of near copies (candidates by
   SimHash's covering search and by minima; sets of five-word runs with a Jaccard similarity of 0.8 at least, checked
   exactly).
3. decontamination: documents that hold a leaked benchmark item go.
4. secret_scans: secrets in the texts are masked.
5. packing: the documents' tokens are packed into sequences; one row per piece.

Every stage but the last returns the columns of documents, with n_chars in step with the text. ``run`` writes each
stage's rows to the folder that all executors share and reads them again, so a lost executor costs one stage's
tasks at most. Documents with a null doc_id can't be told apart, so near_dedup keeps them all; of rows that share an
id and a group one stays, the one with the smallest hash of its text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.llm import decontaminate, near_copies, packing, quality_rules, secrets
from evispark.session import remove, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with the text of another column."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.char_length(text).cast("long")}).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(quality_rules.kept_documents(docs.select(*COLUMNS)), "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.unlike(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), into="__leaks")
    return found.where(F.size("__leaks") == 0).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(docs.withColumn("__masked", secrets.redacted(F.col("text"))), "__masked")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secrets_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fingerprints, the alignment or the tokens; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir. Of the stages' written rows only the last stage's input stays."""
    docs, before, folder = table(spark, sf_dir, "documents"), None, f"{shared_dir(spark)}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
