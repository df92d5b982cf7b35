"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    EARTH_RADIUS_KM,
    FILE_EXTENSION,
    GPS_FILE_SUFFIX,
    GPS_TAG_SUFFIX,
    START_LONG,
    START_SHORT,
)


def finite(value: Column) -> Column:
    """NaN and infinities become null, as in every JSON result."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def epoch_seconds(column: Column, dtype: T.DataType) -> Column:
    """Seconds as double: temporal columns since 1970 (UTC session), numeric columns as they are."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)
    return column.cast("double")


def category(column: Column, dtype: T.DataType) -> Column:
    """Text of a category value. Doubles are written as SQL engines print them: plain digits from 1e-4 (below it, 1e-05) to
    under 1e16, then `1e+16`; `nan`, `inf` and `-inf`."""
    text = column.cast("string")
    if not isinstance(dtype, (T.DoubleType, T.FloatType)):
        return text
    size = F.abs(column.cast("double"))
    plain = F.regexp_replace(F.regexp_replace(column.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    power = F.regexp_extract(text, r"E-?(\d+)$", 1)
    digits = F.regexp_replace(F.regexp_extract(text, "^(.*)E", 1), r"\.0$", "")
    tiny_or_huge = F.concat(digits, F.lit("e"), F.when(size < 1, "-").otherwise("+"), F.when(F.length(power) < 2, "0").otherwise(""), power)
    return (F.when(F.isnan(column), "nan").when(size == float("inf"), F.when(column > 0, "inf").otherwise("-inf"))
            .when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), plain).otherwise(tiny_or_huge))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of an ANSI error for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def plain_number(label: Column) -> Column:
    """The number that a label writes in digits, else null: `9D` and `2F` are labels, though casts read them as numbers."""
    return F.when(label.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), label.try_cast("double"))


def clean_tags(tags: Column) -> Column:
    trimmed = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t))
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def normal_tags(tags: Column) -> Column:
    return F.array_distinct(F.transform(clean_tags(tags), F.lower))


def base_name(name: Column) -> Column:
    """File name without extension and position-log suffix, in lower case: the pairing key."""
    stem = F.regexp_replace(name, FILE_EXTENSION, "")
    return F.lower(F.trim(F.regexp_replace(stem, GPS_FILE_SUFFIX, "")))


def tag_base(tag: Column) -> Column:
    return F.trim(F.regexp_replace(tag, GPS_TAG_SUFFIX, ""))


def recording_start(name: Column) -> Column:
    """First valid start time written in a file name: the long form before the short form."""
    stem = F.regexp_replace(name, FILE_EXTENSION, "")

    def first_valid(pattern: str, century: str) -> Column:
        # the separators hold no digits, so a match is its digits: yyyymmddhhmmss, without the century in the short form
        digits = F.transform(F.regexp_extract_all(stem, F.lit(pattern), F.lit(0)),
                             lambda m: F.concat(F.lit(century), F.regexp_replace(m, r"\D", "")))

        def build(d: Column) -> Column:
            parts = [F.substr(d, F.lit(at), F.lit(2)).cast("int") for at in (5, 7, 9, 11, 13)]
            stamp = F.try_make_timestamp_ntz(
                F.substr(d, F.lit(1), F.lit(4)).cast("int"), *parts[:4], parts[4].cast("decimal(16,6)"))
            return F.when(parts[4] < 60, stamp)

        stamps = F.filter(F.transform(digits, build), lambda s: s.isNotNull())
        return F.get(stamps, F.lit(0))

    return F.coalesce(first_valid(START_LONG, ""), first_valid(START_SHORT, "20"))


def haversine_km(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    half_lat = F.sin(F.radians(y2 - y1) / 2)
    half_lon = F.sin(F.radians(x2 - x1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def planar_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)
