"""Catalog operations on (dataset_id, tags, ...) frames."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clean_tags


def words(values: Seq[str]) -> Column:
    return F.array(*[F.lit(str(v)) for v in values]).cast("array<string>")


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("created_at"), "dataset_id")


def set_tags(catalog: DataFrame, tags: Seq[str] | Column) -> DataFrame:
    """Trimmed tags without empty ones and repeats."""
    return catalog.withColumn("tags", clean_tags(tags if isinstance(tags, Column) else words(tags)))


def edit_tags(catalog: DataFrame, add: Seq[str] = (), remove: Seq[str] = ()) -> DataFrame:
    """Remove tags, then append the missing ones; the order of the kept tags stays."""
    kept = F.array_except("tags", clean_tags(words(remove)))
    return catalog.withColumn("tags", F.array_union(kept, clean_tags(words(add))))


def distinct_tags(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def filter_by_tags(catalog: DataFrame, tags: Seq[str]) -> DataFrame:
    """Rows with any of the tags; all rows when none are given."""
    return catalog.filter(F.arrays_overlap("tags", words(tags))) if tags else catalog


def without(catalog: DataFrame, dataset_ids: Seq[str]) -> DataFrame:
    return catalog.filter(~F.col("dataset_id").isin(list(dataset_ids)))
