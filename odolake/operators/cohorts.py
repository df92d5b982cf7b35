"""Cohorts: sets of recordings named by a tag condition, compared pooled and with equal weight per recording."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import COHORT_METRICS
from ..functions.scalars import clean_tags, ratio
from ..limits import BINS_2D_MAX, MULTI_SIGNALS, require
from .bins import density, percent_within
from .compare import compare_histogram, compare_summary
from .filters import apply_filters
from .frames import lookup, unpivot_rows
from .profile import grouped_stats, spread_quartiles
from .schema import dtype_of, kind_of, require_numeric


def check_specs(specs: list[dict]) -> list[dict]:
    """Trimmed specs; names unique and not empty, at least one tag, match all or any."""
    require(bool(specs), "give at least one cohort")
    out: list[dict] = []
    for spec in specs:
        name = str(spec.get("name", "")).strip()
        require(bool(name), "a cohort needs a name")
        require(name not in [s["name"] for s in out], f"two cohorts are named {name}")
        tags = list(dict.fromkeys(t for t in (str(t).strip() for t in spec.get("tags") or []) if t))
        require(bool(tags), f"cohort {name} needs a tag")
        match = spec.get("match", "all")
        require(match in ("all", "any"), "match is all or any")
        out.append({"name": name, "tags": tags, "match": match})
    return out


def _matches(tags: Column, spec: dict) -> Column:
    wanted = F.array(*[F.lit(t) for t in spec["tags"]])
    if spec["match"] == "any":
        return F.arrays_overlap(tags, wanted)
    return F.size(F.array_except(wanted, tags)) == 0


def membership(catalog: DataFrame, specs: list[dict], *, key: str = "dataset_id") -> DataFrame:
    """(cohort, position, dataset_id, row_count): one row per recording and cohort it belongs to, no join."""
    specs = check_specs(specs)
    tags = clean_tags(F.col("tags"))
    hits = F.array(*[F.when(_matches(tags, s), F.struct(F.lit(i).alias("position"), F.lit(s["name"]).alias("cohort")))
                     for i, s in enumerate(specs)])
    rows = catalog.select(key, *[c for c in ("row_count",) if c in catalog.columns],
                          F.explode(F.array_compact(hits)).alias("m"))
    return rows.select("m.cohort", "m.position", key, *[c for c in ("row_count",) if c in rows.columns])


def resolve(catalog: DataFrame, specs: list[dict]) -> DataFrame:
    """Size of every cohort; an empty cohort is an error."""
    found = membership(catalog, specs).groupBy("cohort", "position").agg(
        F.count(F.lit(1)).alias("dataset_count"), F.sum("row_count").alias("row_count"))
    names = {r["cohort"] for r in found.select("cohort").collect()}  # one row per spec
    for spec in check_specs(specs):
        require(spec["name"] in names, f"no recording matches cohort {spec['name']}")
    return found


def overlaps(members: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Recordings in more than one cohort, with the cohorts in spec order."""
    groups = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "cohort"))).alias("g"))
    return groups.filter(F.size("g") > 1).select(key, F.transform("g", lambda s: s["cohort"]).alias("cohorts"))


def dataset_ids(members: DataFrame, key: str = "dataset_id") -> DataFrame:
    return members.select(key).distinct()


def only_members(df: DataFrame, members: DataFrame, key: str = "dataset_id") -> DataFrame:
    """Rows of recordings in any cohort; prunes the partitioned table."""
    return lookup(df, dataset_ids(members, key), [key], "left_semi")


def _member_count(members: DataFrame) -> DataFrame:
    return members.groupBy("cohort").agg(F.count(F.lit(1)).alias("__members"))


def _roll_up(per_dataset: DataFrame, members: DataFrame, cell: Seq[str], key: str) -> DataFrame:
    """Pooled counts and the mean of the members' percents; a member without a cell counts as zero.

    The rounded percents are added as decimals, so the result does not depend on the order of the merge.
    """
    joined = per_dataset.join(members.select("cohort", key), key)
    cells = joined.groupBy("cohort", *cell).agg(
        F.sum("count").alias("count"), F.sum(F.col("percent").cast("decimal(18,6)")).cast("double").alias("__percents"))
    cells = cells.join(F.broadcast(_member_count(members)), "cohort")  # one row per cohort
    return cells.withColumn("mean_percent", F.round(F.col("__percents") / F.col("__members"), 6)).drop(
        "__percents", "__members")


def _pooled_percent(cells: DataFrame) -> DataFrame:
    whole = Window.partitionBy("cohort")  # at most one row per bin or label
    out = cells.withColumn("total_points", F.sum("count").over(whole))
    share = F.coalesce(F.round(ratio(F.col("count") * 100, F.col("total_points")), 6), F.lit(0.0))
    return out.withColumn("pooled_percent", share)


def cohort_histogram(df: DataFrame, members: DataFrame, column: str, bins: int = 40,
                     filters: list[dict] | None = None, *, as_category: bool = False,
                     key: str = "dataset_id") -> DataFrame:
    """Distribution of each cohort over shared bins or labels: pooled, and with equal weight per recording."""
    rows = only_members(df, members, key)
    per_dataset = compare_histogram(rows, column, bins, filters, as_category=as_category, keys=[key])
    by_label = as_category or kind_of(dtype_of(df, column)) != "numeric"
    cell = ["label", "axis"] if by_label else ["bin", "lower", "upper"]
    return _pooled_percent(_roll_up(per_dataset, members, cell, key))


def cohort_histogram2d(df: DataFrame, members: DataFrame, x: str, y: str, bins_x: int = 40, bins_y: int = 40,
                       filters: list[dict] | None = None, *, key: str = "dataset_id") -> DataFrame:
    """Sparse 2-D densities of each cohort over shared edges; a cohort that the filters empty has one row without a cell."""
    rows = only_members(df, members, key)
    cells = density(rows, x, y, bins_x, bins_y, filters, keys=[key], clamp_low=True, upper=BINS_2D_MAX)
    shares = percent_within(cells, [key], "count", "percent", 6)  # at most 100 x 100 cells per recording
    cells = _pooled_percent(_roll_up(shares, members, ["bin_x", "bin_y", "lower_x", "lower_y"], key))
    return with_every_cohort(cells, members, ["count", "total_points", "pooled_percent", "mean_percent"]) if filters else cells


def signal_names(columns: Seq[str]) -> list[str]:
    """Requested signals without padding, blanks and repeats."""
    return list(dict.fromkeys(c.strip() for c in columns if c.strip()))


def with_every_cohort(found: DataFrame, members: DataFrame, zeros: Seq[str] = (), name: str = "cohort") -> DataFrame:
    """`found` with a row for each cohort that the filters emptied: zeros in the counts, nulls elsewhere."""
    out = members.select(name).distinct().join(found, name, "left")
    return out.select(*[F.coalesce(c, F.lit(0)).cast(found.schema[c].dataType).alias(c) if c in zeros else F.col(c) for c in found.columns])


def representative_values(df: DataFrame, members: DataFrame, columns: Seq[str], metric: str = "avg",
                          filters: list[dict] | None = None, *, key: str = "dataset_id") -> DataFrame:
    """One value per (signal, cohort, recording): the sample of all cohort statistics. One job for all signals."""
    require(metric in COHORT_METRICS, f"metric is one of {', '.join(COHORT_METRICS)}")
    columns = signal_names(columns)
    require(bool(columns), "choose at least one signal")
    require(len(columns) <= MULTI_SIGNALS, f"at most {MULTI_SIGNALS} signals")
    require_numeric(df, *columns)
    rows = apply_filters(only_members(df, members, key), filters)
    name = {"avg": "avg", "std": "std", "max": "max"}.get(metric)
    if name:  # decomposable metrics need no quantiles: one wide aggregation
        function = {"avg": F.avg, "std": F.stddev_samp, "max": F.max}[metric]
        wide = rows.groupBy(key).agg(*[F.struct(
            function(F.col(c).cast("double")).alias("value"), F.count(c).alias("count")).alias(f"s_{i}")
            for i, c in enumerate(columns)])
        cells = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(f"s_{i}.value").alias("value"),
                                   F.col(f"s_{i}.count").alias("count")) for i, c in enumerate(columns)])
        per_dataset = wide.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    elif len(columns) == 1:
        per_dataset = compare_summary(rows, columns[0], keys=[key]).select(
            key, F.lit(columns[0]).alias("signal"), F.col(metric).alias("value"), "count")
    else:
        long = unpivot_rows(rows, [key], columns)
        per_dataset = compare_summary(long, "value", keys=[key, "signal"]).select(
            key, "signal", F.col(metric).alias("value"), "count")
    return per_dataset.join(members.select("cohort", "position", key), key)


def describe_values(values: DataFrame, keys: Seq[str], value: str = "value", *, p90: bool = False) -> DataFrame:
    """n, mean, std, min, q25, median, q75, max (and p90) of a sample per key."""
    probs, names = [0.25, 0.5, 0.75], ["q25", "median", "q75"]
    if p90:
        probs, names = [*probs, 0.9], [*names, "p90"]
    stats = spread_quartiles(grouped_stats(values, keys, value, probs), names)
    return stats.withColumnsRenamed({"count": "n", "avg": "mean"})


def cohort_summary(df: DataFrame, members: DataFrame, columns: Seq[str], metric: str = "avg",
                   filters: list[dict] | None = None, *, key: str = "dataset_id") -> DataFrame:
    """Sample statistics of the recordings' values per (signal, cohort)."""
    values = representative_values(df, members, columns, metric, filters, key=key)
    stats = describe_values(values, ["signal", "cohort"])
    signals = F.explode(F.array(*[F.lit(c) for c in signal_names(columns)])).alias("signal")
    every = members.select("cohort").distinct().select(signals, "cohort")  # cohorts that the filters empty stay
    return every.join(stats, ["signal", "cohort"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
