"""Stages from raw documents to a mixed training set. Each stage reads what the one before it wrote as Parquet.

All stages but the last return the columns of `documents`; a text that loses lines gets its new length as n_chars, where the table has
that column. The last one gives each document's rate. Null and empty texts go in the first stage, as texts without a language.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.llm.decontaminate import keep_clean
from odolake.llm.language import keep_identified
from odolake.llm.line_dedup import drop_boilerplate
from odolake.llm.mixing import TARGETS, label_domains, mixing_rates
from odolake.llm.near_dedup import keep_one
from odolake.llm.tables import column, read
from odolake.session import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that holds at least half of their pooled probability."""
    return keep_identified(docs, min_score=0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    cleaned = drop_boilerplate(docs, host="source", text="text")
    return cleaned.select(*[F.length("text").cast(cleaned.schema[c].dataType).alias(c) if c == "n_chars" else column(cleaned, c).alias(c)
                            for c in cleaned.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate of each document at which the domains reach their target weights."""
    return mixing_rates(docs, label_domains(read(spark, sf_dir, "labels")), TARGETS)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing)]
ORACLE_SQL = None  # the network, the sketches and the alignment have no SQL; tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
