"""Conjunctive filter lists [{column, op, value}]."""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError
from ..functions.scalars import category
from .schema import dtype_of, kind_of, resolve_column

COMPARE = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
}


def _compare_number(column: Column, op: str, value: float, dtype: T.DataType) -> Column:
    """The comparison; of whole numbers with a whole bound, which the scan can apply to its statistics."""
    if not isinstance(dtype, T.IntegralType) or not abs(value) < 2**53:
        return COMPARE[op](column, F.lit(value))
    if value != int(value) and op in ("eq", "ne"):
        return column.isNotNull() if op == "ne" else F.lit(False)
    bound = math.ceil(value) if op in ("ge", "lt") else math.floor(value)
    return COMPARE[op](column, F.lit(bound).cast("bigint"))


_PERIOD = re.compile(r"([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2})(?: ([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,6}))?)?)?)?)?)?")


def _period(text: str) -> tuple[datetime, datetime] | None:
    """Start and end of the longest period whose text the given one begins with: a year, month, day, hour, minute, second or fraction."""
    match = _PERIOD.match(text)
    parts = [p for p in match.groups() if p is not None] if match else []
    for size in range(len(parts), 0, -1):
        numbers = [int(p) for p in parts[:size]]
        if size == 7:
            numbers[6] *= 10 ** (6 - len(parts[6]))
        try:
            start = datetime(*(numbers + [1, 1][size - 1:]))
            if size == 1:
                return start, datetime(numbers[0] + 1, 1, 1)
            if size == 2:
                return start, datetime(numbers[0] + numbers[1] // 12, numbers[1] % 12 + 1, 1)
            length = {3: 86_400, 4: 3_600, 5: 60, 6: 1}.get(size)
            return start, start + (timedelta(seconds=length) if length else timedelta(microseconds=10 ** (6 - len(parts[6]))))
        except (ValueError, OverflowError):
            continue
    return None


def _time_range(df: DataFrame, column: Column, op: str, value: str, dtype: T.DataType) -> Column | None:
    """A range of times that holds every row whose text compares so, for scans to apply; None where none is known.

    Texts sort as their times do in the years 1 to 9999; rows outside are left to the comparison of texts.
    """
    period = _period(value)
    if period is None or op == "ne":
        return None
    if isinstance(dtype, T.TimestampType) and df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
        return None
    day = isinstance(dtype, T.DateType)

    def at(moment: datetime) -> Column:
        text = moment.strftime("%m-%d") if day else moment.strftime("%m-%d %H:%M:%S.%f")
        return F.lit(f"{moment.year:04d}-{text}").cast(dtype)

    start, end = period
    inside = column >= at(start) if op in ("eq", "gt", "ge") else column <= at(end)
    if op == "eq":
        inside = inside & (column <= at(end))
    return inside | (column < at(datetime.min)) | (column > at(datetime.max))


def _condition(df: DataFrame, item: dict) -> Column:
    name, op, value = item.get("column"), item.get("op"), item.get("value")
    kind = kind_of(dtype_of(df, name))
    column = F.col(f"`{name}`")
    if op in COMPARE:
        if kind == "numeric":
            try:
                number = float(value)
            except (TypeError, ValueError):
                raise RequestError(f"not a number for {name}: {value!r}") from None
            return _compare_number(column, op, number, dtype_of(df, name))
        texts = COMPARE[op](column.cast("string"), F.lit(str(value)))
        times = _time_range(df, column, op, str(value), dtype_of(df, name)) if kind == "temporal" else None
        return texts if times is None else times & texts
    if op == "contains":
        # % and _ in the value act as wildcards
        return category(column, dtype_of(df, name)).like("%" + str(value).replace("\\", "\\\\") + "%")
    if op == "notnull":
        return column.isNotNull()
    if op == "isnull":
        return column.isNull()
    raise RequestError(f"unknown filter operation: {op}")


def apply_filters(df: DataFrame, filters: list[dict] | None) -> DataFrame:
    if not filters:
        return df
    return df.filter(reduce(and_, [_condition(df, f) for f in filters]))


def resolvable_filters(filters: list[dict] | None, target_columns, aliases: list[tuple[str, str]]) -> list[dict]:
    """Filters rewritten for another run; those whose column it lacks are dropped."""
    out = []
    for item in filters or []:
        column = resolve_column(item["column"], target_columns, aliases)
        if column:
            out.append({**item, "column": column})
    return out
