"""Exact linear-interpolation quantiles per group, for groups of any size.

Small groups use `percentile`. Others are selected by pivots: one scan sketches two values around every wanted rank, for all
groups and columns at once; a second scan counts map-side what lies between those pivots, and keeps the values themselves only
inside a pair. The exact counts tell which rank each kept value has, so the result does not depend on the sketch. Only the
kept values, a few thousandths of the input for each probability, are ever sorted. A rank that a sketch missed is found by
sorting the group.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import (
    BROADCAST_CONF,
    BROADCAST_DEFAULT,
    DISTINCT_CONF,
    DISTINCT_DEFAULT,
    SORTED_CONF,
    SORTED_DEFAULT,
    TASK_DISTINCT_CONF,
    TASK_DISTINCT_DEFAULT,
    TASK_GROUPS,
    conf_int,
)
from ..session import materialize
from .frames import beside, unpivot_rows
from .ordered import Ordered

SKETCH_ACCURACY = 10_000  # a sketched rank is off by at most this part of the rows
CURVE_PROBS = 10  # from more probabilities on, ranks are cheaper than `percentile`


def fitting_columns(df: DataFrame, keys: Seq[str], columns: Seq[str]) -> list[str]:
    """Columns whose distinct values per group are few enough for `percentile`, which keeps them in one task.

    One scan with map-side sketches for all columns; a 20 % margin covers their error.
    """
    spark = df.sparkSession
    per_group = conf_int(spark, DISTINCT_CONF, DISTINCT_DEFAULT)
    per_task = conf_int(spark, TASK_DISTINCT_CONF, TASK_DISTINCT_DEFAULT)
    if df.count() <= min(per_group, per_task):  # no more rows than values allowed; from the footers of plain scans
        return list(columns)
    sketches = df.groupBy(*keys).agg(*[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)])
    row = sketches.agg(F.count(F.lit(1)), *[F.max(f"n{i}") for i in range(len(columns))]).first()
    groups = min(TASK_GROUPS, row[0])
    return [c for c, n in zip(columns, row[1:]) if (n or 0) * 1.2 <= min(per_group, per_task / max(1, groups))]


def fits_in_memory(df: DataFrame, keys: Seq[str], columns: Seq[str]) -> bool:
    return len(fitting_columns(df, keys, columns)) == len(columns)


def quantile_column(column: str, probs: Seq[float]) -> Column:
    return F.percentile(F.col(column), [float(p) for p in probs])


def quantiles(df: DataFrame, keys: Seq[str], column: str, probs: Seq[float], name: str = "quantiles", *,
              in_memory: bool | None = None) -> DataFrame:
    """(keys, name ARRAY<DOUBLE>): one value per probability; groups without values are absent.

    A few probabilities of groups that fit a task use `percentile`; its cost grows with the number of
    probabilities, so whole curves are selected by pivots, as are groups that do not fit.
    """
    rows = df.filter(F.col(column).isNotNull())
    if in_memory is None:
        in_memory = len(probs) <= CURVE_PROBS and fits_in_memory(rows, keys, [column])
    if in_memory:
        return rows.groupBy(*keys).agg(quantile_column(column, probs).alias(name))
    return all_quantiles(rows, keys, [column], probs, name).drop("signal")


def all_quantiles(df: DataFrame, keys: Seq[str], columns: Seq[str], probs: Seq[float], name: str = "quantiles") -> DataFrame:
    """(keys, signal, name ARRAY<DOUBLE>) of every column: by sorting where there are few values in all, else by pivots.

    Groups without values of a column have no row for it. Null keys are a group of their own.
    """
    if df.count() * len(columns) > conf_int(df.sparkSession, SORTED_CONF, SORTED_DEFAULT):
        return pivot_quantiles(df, keys, columns, probs, name)
    group = [*(keys or ["__all"]), "signal"]
    rows = df if keys else df.withColumn("__all", F.lit(0))
    rows = unpivot_rows(rows, group[:-1], columns).filter(F.col("value").isNotNull())
    return _by_rank(rows, group, "value", [float(p) for p in probs], name).drop("__all")


def _touched(probs: list[float], first: Column, last: Column, gaps: Column) -> tuple[Column, Column]:
    """Range of probability indexes whose position may fall beside the ranks first..last of n = gaps + 1."""
    step = (probs[-1] - probs[0]) / max(1, len(probs) - 1)
    even = len(probs) > 1 and all(abs(p - probs[0] - i * step) < 1e-12 for i, p in enumerate(probs))
    top = F.lit(len(probs) - 1)
    if not even:
        return F.lit(0), top
    scale = F.greatest(gaps, F.lit(1)) * F.lit(step)
    low = F.floor((first - 1 - gaps * F.lit(probs[0])) / scale - 1e-6)
    high = F.ceil((last + 1 - gaps * F.lit(probs[0])) / scale + 1e-6)
    return F.greatest(F.lit(0), low).cast("int"), F.least(top, high).cast("int")


def _brackets(probs: Seq[float]) -> list[float]:
    """Sketched probabilities: the ends of disjoint intervals around the wanted ones, ascending."""
    reach, ends = 2.0 / SKETCH_ACCURACY, []
    for p in sorted(set(probs)):
        low, high = max(0.0, p - reach), min(1.0, p + reach)
        if ends and low <= ends[-1]:
            ends[-1] = high
        else:
            ends += [low, high]
    return ends


def _place(column: str, pivots: str, count: int) -> Column:
    """The number of pivots below the column, by binary search.

    Each step names the one before it twice; generated code computes common parts once, so a step is one comparison.
    """
    low, step = F.lit(0), 1 << max(0, count.bit_length() - 1)
    while step:
        above = F.col(column) > F.get(F.col(pivots), low + (step - 1))  # null beyond the last pivot
        low = low + F.coalesce(above.cast("int"), F.lit(0)) * step
        step //= 2
    return low


def _beside_keys(rows: DataFrame, table: DataFrame, keys: Seq[str], values: int) -> DataFrame:
    """Join rows with a table of one row per key that holds `values` doubles; broadcast only where it is small in all.

    Null keys match null keys.
    """
    if not keys:
        return beside(rows, table)
    if table.count() * max(1, values // 8) <= conf_int(table.sparkSession, BROADCAST_CONF, BROADCAST_DEFAULT):
        table = F.broadcast(table)
    renamed = table.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return rows.join(renamed, match).drop(*[f"__r_{k}" for k in keys])


def pivot_quantiles(df: DataFrame, keys: Seq[str], columns: Seq[str], probs: Seq[float], name: str = "quantiles") -> DataFrame:
    """`all_quantiles` with two scans for all columns together."""
    keys, columns, probs = list(keys), list(columns), [float(p) for p in probs]
    ends = _brackets(probs)
    wide = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"__v{i}") for i, c in enumerate(columns)])
    sketches = materialize(wide.groupBy(*keys).agg(
        *[F.percentile_approx(f"__v{i}", ends, SKETCH_ACCURACY).alias(f"__p{i}") for i in range(len(columns))]))
    rows = _beside_keys(wide, sketches, keys, len(ends) * len(columns))
    rows = rows.select("*", *[_place(f"__v{i}", f"__p{i}", len(ends)).alias(f"__i{i}") for i in range(len(columns))])
    kept, cells = [], []
    for i in range(len(columns)):
        place, value = F.col(f"__i{i}"), F.col(f"__v{i}")
        # an odd place is between the two pivots of a pair; a value equal to a pivot stands for itself as well
        keeps = (place % 2 == 1) | F.coalesce(F.get(f"__p{i}", place) == value, F.lit(False))
        kept += [F.when(value.isNotNull(), place).alias(f"__i{i}"), F.when(keeps, value).alias(f"__v{i}")]
        cells.append(F.struct(F.lit(i).alias("__s"), F.col(f"__i{i}").alias("__i"), F.col(f"__v{i}").alias("__v")))
    rows = rows.select(*keys, *kept)  # without the pivots, which would be copied with every cell
    by = [*keys, "__s"]
    single = rows.select(*keys, F.explode(F.array(*cells)).alias("__c")).select(*keys, "__c.*").filter(F.col("__i").isNotNull())
    counts = materialize(single.groupBy(*by, "__i", "__v").agg(F.count(F.lit(1)).alias("__c")))
    places = counts.groupBy(*by, "__i").agg(F.sum("__c").alias("__m"))  # at most one per pivot and group
    group = Window.partitionBy(*by)
    places = places.select(
        *by, "__i", F.sum("__m").over(group).alias("__n"), (F.sum("__m").over(group.orderBy("__i")) - F.col("__m")).alias("__below"),
        (F.sum("__m").over(group.orderBy("__i")) - 1).alias("__top"))
    gaps = (F.col("__n") - 1).cast("double")
    if len(probs) <= CURVE_PROBS:
        wanted = [rank(gaps * p).between(F.col("__below"), F.col("__top")) for p in probs for rank in (F.floor, F.ceil)]
        places = places.filter(reduce(or_, wanted))
    else:
        low, high = _touched(probs, F.col("__below"), F.col("__top"), gaps)
        places = places.filter(low <= high)
    at = {"__i": "__at"}
    held = _beside_keys(counts.withColumnsRenamed(at), materialize(places.withColumnsRenamed(at)), [*by, "__at"], 8)
    # what lies between pairs comes before the value of the pivot that ends it
    held = held.withColumn("__known", F.col("__v").isNotNull())
    ranked = Ordered(held, [*by, "__at"], ["__known", "__v"]).running_sum({"__hi": F.col("__c")}).df
    ranked = ranked.select(*by, "__v", (F.col("__below") + F.col("__hi") - F.col("__c")).alias("__first"),
                           (F.col("__below") + F.col("__hi") - 1).alias("__last"), gaps.alias("__gaps"))
    found = materialize(_near(ranked, by, probs))
    missed = found.filter(F.col("__v").isNull()).select(*by).distinct()
    out = _interpolated(found.filter(F.col("__v").isNotNull()), by, probs, name)
    if not missed.isEmpty():  # a sketch was further off than it should be
        sorted_out = [_by_rank(wide.withColumn("__s", F.lit(i)).filter(F.col(f"__v{i}").isNotNull()), by, f"__v{i}", probs, name)
                      for i in range(len(columns))]
        again = _beside_keys(reduce(DataFrame.unionByName, sorted_out), missed, by, 1)
        keep = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in by])
        out = out.join(missed.withColumnsRenamed({k: f"__r_{k}" for k in by}), keep, "left_anti").unionByName(again)
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(*keys, F.get(names, F.col("__s")).alias("signal"), name)


def _by_rank(rows: DataFrame, keys: list[str], column: str, probs: list[float], name: str) -> DataFrame:
    """Quantiles from cumulative counts of distinct values: copies collapse map-side before the sort."""
    counts = rows.groupBy(*keys, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counts = materialize(counts)  # read by the size check, the sizes and the sort
    ranked = Ordered(counts, keys, ["__v"]).running_sum({"__hi": F.col("__c")}).totals({"__n": F.sum("__c")}).df
    ranked = ranked.select(*keys, "__v", (F.col("__hi") - F.col("__c")).alias("__first"), (F.col("__hi") - 1).alias("__last"),
                           (F.col("__n") - 1).cast("double").alias("__gaps"))
    return _interpolated(_near(ranked, keys, probs), keys, probs, name)


def _near(ranked: DataFrame, group: list[str], probs: list[float]) -> DataFrame:
    """(group, i, pos, __v, __first, __last): values of the ranks __first..__last beside the position of probability i."""
    first, last, gaps = F.col("__first"), F.col("__last"), F.col("__gaps")
    if len(probs) <= CURVE_PROBS:
        near = [F.floor(gaps * p).between(first, last) | F.ceil(gaps * p).between(first, last) for p in probs]
        ranked = ranked.filter(reduce(or_, near))
    low, high = _touched(probs, first, last, gaps)
    numbers = F.array(*[F.lit(p) for p in probs])
    hit = ranked.filter(low <= high).select(*group, "__v", "__first", "__last", "__gaps", F.explode(F.sequence(low, high)).alias("i"))
    hit = hit.withColumn("pos", F.element_at(numbers, F.col("i") + 1) * F.col("__gaps"))
    beside_it = [rank(F.col("pos")).between(F.col("__first"), F.col("__last")) for rank in (F.floor, F.ceil)]
    return hit.filter(beside_it[0] | beside_it[1]).drop("__gaps")


def _interpolated(hit: DataFrame, group: list[str], probs: list[float], name: str) -> DataFrame:
    below = F.when(F.floor("pos").between(F.col("__first"), F.col("__last")), F.col("__v"))
    above = F.when(F.ceil("pos").between(F.col("__first"), F.col("__last")), F.col("__v"))
    each = hit.groupBy(*group, "i").agg(F.first("pos").alias("pos"), F.max(below).alias("lo"), F.max(above).alias("hi"))
    weight = F.col("pos") - F.floor("pos")
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * weight  # exactly the value when both neighbours are equal
    out = each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))).alias("__a"))
    return out.select(*group, F.transform("__a", lambda s: s["v"]).alias(name))  # one entry per probability
