"""Reading of many files at once: dialects and types are found for all files together, and no row is moved to be numbered.

Three scans, whatever the number of files: the lines give each file's separator and header, the values give each column's
type and the number of rows of every block, and the typed read adds to a row's place in its block the rows of the blocks before.
Files that agree in dialect, names and types share a read.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from collections.abc import Sequence as Seq
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import require
from ..operators.frames import lookup
from ..session import materialize

SEPARATORS = (",", ";", "\t", "|")
BOM = "﻿"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(?i:[+-]?(nan|inf|infinity))$"
# a value is of the first kind that fits; the bits of a column's values say what it can be read as
_KINDS = (("boolean", r"^(?i:true|false)$"), ("bigint", r"^[+-]?\d{1,18}$"), ("double", _NUMBER), ("date", r"^\d{4}-\d{2}-\d{2}$"),
          ("timestamp", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"))
_TEXT = 1 << len(_KINDS)
_READ_AS = {1: "boolean", 2: "bigint", 4: "double", 6: "double", 8: "date", 16: "timestamp", 24: "timestamp"}


@dataclass(frozen=True)
class Dialect:
    separator: str
    header: bool
    names: tuple[str, ...]


@dataclass
class Batch:
    """Files of one dialect, names and types: `rows` has the typed columns, __file and row_pos."""

    rows: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def source_file() -> Column:
    """Path of a row's file as it was listed; the scan reports it as an escaped URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _names(fields: Seq[str], header: bool) -> tuple[str, ...]:
    out: list[str] = []
    for i, text in enumerate(fields):
        name = text.strip() if header and text.strip() else f"column{i}"
        base, n = name, 0
        while name.lower() in (x.lower() for x in out):
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return tuple(out)


def dialect_of(first_line: str, ranges: dict[str, tuple[int, int]]) -> Dialect:
    """Dialect from a file's first line and the (fewest, most) separators of its lines.

    The separator is one that all lines have equally often, the most frequent of several; else the one that each line has
    most of; else the comma. A first line with a number, a date or an empty field is no header.
    """
    even = [s for s in SEPARATORS if ranges[s][0] == ranges[s][1] and ranges[s][0] > 0]
    some = [s for s in SEPARATORS if ranges[s][0] > 0]
    separator = max(even or some or [","], key=lambda s: (ranges[s][0], -SEPARATORS.index(s)))
    fields = next(csv.reader([first_line.removeprefix(BOM)], delimiter=separator), [])
    values = any(not f.strip() or any(re.search(pattern, f.strip()) for _, pattern in _KINDS) for f in fields)
    return Dialect(separator, not values, _names(fields, not values))


def sniff(spark: SparkSession, paths: Seq[str]) -> dict[str, Dialect]:
    """Dialect by file path of CSV files; empty files have none. One scan with map-side sums over all lines."""
    lines = spark.read.text(list(paths)).select(
        "value", source_file().alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))
    lines = lines.filter(F.trim("value") != "")
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counts = [F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit(""))) for s in SEPARATORS]
    found = lines.groupBy("file").agg(F.min_by("value", "place").alias("first"),
                                      *[f(c).alias(f"{n}{i}") for i, c in enumerate(counts) for n, f in (("a", F.min), ("b", F.max))])
    return {r["file"]: dialect_of(r["first"], {s: (r[f"a{i}"], r[f"b{i}"]) for i, s in enumerate(SEPARATORS)})
            for r in found.toLocalIterator()}  # one row a file


def _kind_bits(value: Column) -> Column:
    text, bits = F.trim(value), F.lit(_TEXT)
    for i, (_, pattern) in reversed(list(enumerate(_KINDS))):
        bits = F.when(text.rlike(pattern), 1 << i).otherwise(bits)
    return F.when(text.isNull() | (text == ""), 0).otherwise(bits)


def _texts(spark: SparkSession, paths: Seq[str], dialect: Dialect, encoding: str) -> DataFrame:
    """All columns as text, with the file, its block and the row's place in the block's task."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(dialect.names))])
    df = spark.read.schema(schema).csv(list(paths), sep=dialect.separator, header=dialect.header, encoding=encoding)
    first = F.regexp_replace("c0", f"^{BOM}", "")  # the mark stays in a first line without header
    return df.select(source_file().alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                     F.monotonically_increasing_id().alias("__at"), first.alias("c0"), *df.columns[1:])


def read_csv_files(spark: SparkSession, paths: Seq[str], *, encoding: str = "UTF-8", separator: str | None = None) -> Iterator[Batch]:
    """Batches of CSV files by dialect and types; types come from all values, integers are BIGINT.

    Files without a line give no batch. Rows with fewer fields end in nulls.
    """
    dialects: dict[Dialect, list[str]] = {}
    for path, dialect in sorted(sniff(spark, paths).items()):
        if separator:
            dialect = Dialect(separator, dialect.header, dialect.names)
        dialects.setdefault(dialect, []).append(path)
    for dialect, files in dialects.items():
        width = len(dialect.names)
        every = _texts(spark, files, dialect, encoding)
        blocks = materialize(every.groupBy("__file", "__block").agg(
            F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"), *[F.bit_or(_kind_bits(F.col(f"c{i}"))).alias(f"k{i}") for i in range(width)]))
        before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        kinds: dict[tuple, dict[str, int]] = {}
        per_file = blocks.groupBy("__file").agg(F.sum("n").alias("n"), *[F.bit_or(f"k{i}").alias(f"k{i}") for i in range(width)])
        for r in per_file.toLocalIterator():  # one row a file
            types = tuple(_READ_AS.get(r[f"k{i}"], "string") for i in range(width))
            kinds.setdefault(types, {})[r["__file"]] = r["n"]
        for path in set(files).difference(*kinds.values()):  # a header alone
            kinds.setdefault(("string",) * width, {})[path] = 0
        for types, counts in kinds.items():
            # places hold for one frame, whose scans all deal the same blocks to the same tasks
            texts = every if len(kinds) == 1 else _texts(spark, list(counts), dialect, encoding)
            if len(kinds) > 1:
                firsts = texts.groupBy("__file", "__block").agg(F.min("__at").alias("first"), F.count("c0"))
                own = materialize(firsts.drop("count(c0)").join(blocks.select("__file", "__block", "n"), ["__file", "__block"]))
            else:
                own = blocks
            before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
            starts = own.select("__file", "__block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("__shift"))
            typed = [(F.col(f"c{i}") if t == "string" else F.trim(f"c{i}").try_cast(t)).alias(name)
                     for i, (t, name) in enumerate(zip(types, dialect.names, strict=True))]
            placed = lookup(texts, starts, ["__file", "__block"])
            yield Batch(placed.select("__file", (F.col("__at") + F.col("__shift")).alias("row_pos"), *typed), counts)


def read_parquet_files(spark: SparkSession, paths: Seq[str]) -> Iterator[Batch]:
    """Batches of Parquet files by schema, rows numbered by their index in the file."""
    from .readers import widen_integers

    with ThreadPoolExecutor(16) as pool:  # footers only
        schemas = list(pool.map(lambda p: spark.read.parquet(p).schema, paths))
    shapes: dict[str, list[str]] = {}
    for path, schema in zip(paths, schemas, strict=True):
        shapes.setdefault(schema.json(), []).append(path)
    for files in shapes.values():
        df = spark.read.parquet(*files)
        placed = df.select(source_file().alias("__file"), F.col("_metadata.row_index").alias("row_pos"), *[F.col(f"`{c}`") for c in df.columns])
        counts = {r["__file"]: r["n"] for r in df.groupBy(source_file().alias("__file")).agg(
            F.count(F.lit(1)).alias("n")).toLocalIterator()}  # one row a file
        yield Batch(widen_integers(placed), counts)


def check_positions(positions: DataFrame, counts: dict[str, int], key: str) -> None:
    """Refuse rows whose positions are not 0..n-1 in every recording; one scan of the written positions."""
    found = positions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("row_pos").alias("low"), F.max("row_pos").alias("high"),
                                       F.sum("row_pos").alias("s"))
    seen = {r[key]: (r["n"], r["low"], r["high"], r["s"]) for r in found.toLocalIterator()}
    wrong = [k for k, n in counts.items() if n and seen.get(k) != (n, 0, n - 1, n * (n - 1) // 2)]
    require(not wrong, f"rows of {len(wrong)} files were not numbered in full; nothing was stored")
