"""The corpus pipeline: quality rules, near copies, benchmark leaks, personal data, tokens.

Each stage takes all documents that the one before kept, as written Parquet, and returns documents again; the last one
returns their tokens. Stages that filter keep every clean document. Rows without an id are judged like the others, but for
copies: without an id to choose by they are compared with nothing and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from limnoscope.llm import decontaminate, near_dedup, pii, quality_rules, sentencepiece_codec
from limnoscope.llm.queries import public_model, table
from limnoscope.llm.rows import free_name
from limnoscope.session import scratch_path


#: Stages compare five words at 0.8; two words are the contract of op5_minhash_near_dedup alone.
STAGE_SKETCH = near_dedup.Sketch(shingle_words=5)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the divergence rules keep."""
    # A prefix that no column has leaves columns named like the rules' own untouched.
    prefix = free_name(docs, "rule_")
    return quality_rules.verdicts(docs, prefix=prefix).where(F.col(f"{prefix}kept")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; only rows of one id and text are one.

    Different texts that share an id are different documents.
    """
    return near_dedup.without_copies(docs, STAGE_SKETCH)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = free_name(docs, "leaks")
    flagged = decontaminate.flagged(docs, table(spark, sf_dir, "benchmark"), into=leaks)
    return flagged.where(F.size(leaks) == 0).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the new text."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document, their count, and digests of the ids and of the decoded text."""
    return sentencepiece_codec.digests(docs, public_model(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("sentencepiece", sentencepiece_stage),
]

# Windows of words, minimum hashes, trained weights and merges are beyond SQL; tests/llm compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
