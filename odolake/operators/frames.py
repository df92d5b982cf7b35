"""Small helpers on DataFrames: joins with lookup tables whose size is checked, null-safe keys."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..limits import BROADCAST_CONF, BROADCAST_DEFAULT, conf_int, require
from ..session import materialize


def require_columns(df: DataFrame, *names: str | None) -> None:
    for name in names:
        if name is not None:
            require(name in df.columns, f"no such column: {name}")


def beside(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as constants of the plan (nulls when it is empty).

    The aggregate runs once, and the expressions that use it stay in one generated stage with the scan.
    """
    values = single.first()
    return rows.select("*", *[F.lit(values[f.name] if values else None).cast(f.dataType).alias(f.name)
                              for f in single.schema.fields])


def repeat_for(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Every row once per row of a table that is small by construction: an axis, a bin grid, the cohorts."""
    fields = small.schema.fields
    entries = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in fields]) for r in small.collect()]
    if not entries:
        return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).filter(F.lit(False))
    out = rows.select("*", F.explode(F.array(*entries)).alias("__entry"))
    return out.select("*", *[F.col(f"__entry.{f.name}").alias(f.name) for f in fields]).drop("__entry")


def join_on(left: DataFrame, right: DataFrame, keys: Seq[str], how: str = "inner",
            null_keys: Seq[str] = ()) -> DataFrame:
    """Equi-join on `keys`, where the columns named in `null_keys` also match null with null."""
    if not keys:
        return beside(left, right)  # keyless right sides are one-row aggregates
    if not null_keys:
        return left.join(right, list(keys), how)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        match = (F.col(key).eqNullSafe(F.col(f"__r_{key}")) if key in null_keys
                 else F.col(key) == F.col(f"__r_{key}"))
        condition = match if condition is None else condition & match
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def lookup(left: DataFrame, table: DataFrame, keys: Seq[str], how: str = "inner", *,
           written: bool = False) -> DataFrame:
    """Join a fact table with a per-key table.

    The per-key side is computed once into a table (unless it is `written` already), counted from its footers,
    and broadcast only within the bound. Otherwise it is an ordinary equi-join, whose hot partitions adaptive execution splits.
    """
    if not keys:
        return beside(left, table)  # a one-row aggregate
    table = table if written else materialize(table)
    if table.count() <= conf_int(table.sparkSession, BROADCAST_CONF, BROADCAST_DEFAULT):
        table = F.broadcast(table)
    return left.join(table, list(keys), how)


def unpivot_rows(df: DataFrame, ids: Seq[str], columns: Seq[str], name: str = "signal",
                 value: str = "value") -> DataFrame:
    """Long form (ids, name, value as double), one narrow stage."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(*ids, F.explode(pairs).alias("__p")).select(*ids, f"__p.{name}", f"__p.{value}")


def sort_last(*names: str) -> list[Column]:
    return [F.col(n).asc_nulls_last() for n in names]
