"""Boilerplate lines by their site-relative frequency: the share of a host's pages that contain a line.

A page is a different text of the host, so mirrored copies of one page count once. Lines that exceed the ratio go from every page
of their host. Only expressions and joins are used; texts are shuffled only where the hosts' line sets are too large
to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import lookup
from .tables import column, free_name

RATIO = 0.01  # ordinary lines stand on some pages of a host at most; lines of a site on 1 % to 13 %
MIN_PAGES = 5
_LINE_END = "\n"


def _host_key(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit("none"))


def _line_key(line: Column) -> Column:
    """Two independent 64-bit hashes, so that different lines stay different at any size."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host_key, keys): the keys of each host's lines that stand on more than `ratio` of its pages, and on `min_pages` at least.

    A host has at most (mean lines of a page / ratio) such lines, whatever its size, so its set is one small array.
    """
    pages = docs.select(_host_key(column(docs, host)).alias("host_key"), column(docs, text).alias("t")).filter(F.col("t").isNotNull())
    keyed = pages.withColumn("page", F.xxhash64("t"))
    totals = keyed.select("host_key", "page").distinct().groupBy("host_key").agg(F.count(F.lit(1)).alias("total"))
    lines = keyed.select("host_key", "page", F.explode(F.array_distinct(F.split("t", _LINE_END))).alias("line")).filter(F.trim("line") != "")
    on_pages = lines.select("host_key", "page", _line_key(F.col("line")).alias("k")).select("host_key", "page", "k.*").distinct()
    counts = on_pages.groupBy("host_key", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    common = lookup(counts, totals, ["host_key"]).filter(F.col("n") > F.lit(float(ratio)) * F.col("total"))
    return common.groupBy("host_key").agg(F.collect_list(F.struct("a", "b")).alias("keys"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, dropped: str | None = None) -> DataFrame:
    """`docs` with the boilerplate lines of each host taken out of `text`; all rows and other columns stay as they are.

    Rows without a host form one host. Null texts stay null, blank lines are never boilerplate, and a text that loses all its lines
    becomes empty. Repeated rows are treated alike. `dropped` names a column that gets the number of lines taken out.
    """
    host_key, keys = free_name(docs, "host_key"), free_name(docs, "line_keys")
    sets = boilerplate(docs, host, text, ratio, min_pages).withColumnsRenamed({"host_key": host_key, "keys": keys})
    found = lookup(docs.withColumn(host_key, _host_key(column(docs, host))), sets, [host_key], "left")
    lines = F.split(column(docs, text), _LINE_END)
    kept = F.filter(lines, lambda line: ~F.array_contains(F.col(keys), _line_key(line)))
    out = [F.when(F.col(keys).isNull(), column(docs, c)).otherwise(F.array_join(kept, _LINE_END)).alias(c) if c == text
           else column(docs, c).alias(c) for c in docs.columns]
    if dropped:
        out.append(F.when(F.col(keys).isNull(), 0).otherwise(F.coalesce(F.size(lines) - F.size(kept), F.lit(0))).alias(dropped))
    return found.select(*out)
