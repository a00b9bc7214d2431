"""From raw documents to packed sequences, as stages that each work on what the one before has kept.

Defined cases, for every stage: a null or empty text is of no language and goes in the first stage, and
wherever it comes later it is scored, linked and packed as its operator says; a null doc_id is judged by its
text, and stays where only an id could drop it (near_dedup); repeated rows are kept or dropped alike, but near_dedup
leaves one of each doc_id; ties go as the operators say; very long texts are read whole; an empty table gives an
empty table; extra columns of any name pass through all stages but the last, which returns its own.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import decontamination, language_id, near_copies, packing, quality_classifier
from chatloom.llm.common import documents, kept_rows
from chatloom.session import removed, shared_dir

#: A text farther than this from every language profile is of no known language.
LEAST_LANGUAGE_SCORE = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: texts with a letter whose nearest profile is near enough. With no language to learn from none stays."""
    keeps = language_id.in_known_language(language_id.learn_profiles(docs, language_id.teaching_rows()), LEAST_LANGUAGE_SCORE)
    return kept_rows(docs, keeps, most_chars=language_id.SLICE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier passes (score 0.3 or more, a tie stays); it learns from labels of what is left. Without labels all stay."""
    model = quality_classifier.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", quality_classifier.teaching_rows())
    sent = spark.sparkContext.broadcast(model)
    return kept_rows(docs, lambda texts: np.asarray(sent.value.score(texts)) >= quality_classifier.PREDICT_AT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that 5-word shingle similarities of 0.8 or more link; rows without an id stay."""
    return near_copies.without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item to the threshold. With an empty benchmark all stay."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences; an empty text is its end token."""
    return packing.packed(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: Neither the learned stages nor shingle sets and tiles can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's result is written as Parquet in the shared folder and read again; what the next stage has read is removed."""
    docs, root, before = documents(spark, sf_dir), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if before:
            removed(spark, before)
        before = f"{root}/{name}"
    return docs
