"""Chart-builder aggregates. `keys` names the series that are kept apart: recordings, or groups of recordings."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CHART_AGGREGATES
from ..functions.scalars import category, finite, ratio
from ..limits import (
    BOX_CARDINALITY,
    BOX_COLOR_CARDINALITY,
    CATEGORY_LABELS,
    CHART_GROUPS,
    COLOR_GROUPS,
    POINTS_PER_SERIES_MIN,
    clamp_bins,
    clamp_points,
    require,
)
from ..session import materialize
from .bins import bin_grid, bin_of, density, percent_within, top_labels, value_range
from .compare import guard_cardinality
from .filters import apply_filters
from .frames import beside, join_on, lookup, repeat_for, require_columns
from .profile import box_stats, grouped_stats
from .sampling import every_stride, top_rows
from .schema import dtype_of, kind_of, require_numeric


def _label(df: DataFrame, column: str | None) -> Column:
    return category(F.col(column), dtype_of(df, column)) if column else F.lit("")


def first_colors(rows: DataFrame, keys: Seq[str], color: str = "color") -> DataFrame:
    """The alphabetically first 8 colour labels of each series; null sorts last."""
    names = rows.select(*keys, color).distinct()
    return top_rows(names, keys, [F.col(color).asc_nulls_last()], COLOR_GROUPS, "color_rank")


def _on_axis(cells: DataFrame, axis: DataFrame, axis_keys: Seq[str]) -> DataFrame:
    """Cells whose category is on the axis; an axis shared by all series has at most 40 rows."""
    return cells.join(axis if axis_keys else F.broadcast(axis), [*axis_keys, "category"])


def _aggregate(kind: str, y: str | None) -> Column:
    if kind in ("count", "share"):
        return F.count(F.lit(1)).cast("double")
    value = F.col(y).cast("double")
    simple = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    return simple[kind](value)


def bar(df: DataFrame, x: str, y: str | None = None, color: str | None = None, agg: str = "avg",
        filters: list[dict] | None = None, *, keys: Seq[str] = (), shared_axis: bool = False) -> DataFrame:
    """One value per (series, colour, category): the 40 largest categories, the first 8 colours.

    `share` is the percent inside the colour over all its categories, not only those shown. With
    `shared_axis` the categories are chosen over all series together.
    """
    require(agg in CHART_AGGREGATES, f"unknown aggregate: {agg}")
    require_columns(df, x, color)
    if agg not in ("count", "share"):
        require_numeric(df, y)
    rows = apply_filters(df, filters).filter(F.col(x).isNotNull())
    carried = [y] if agg not in ("count", "share") else []
    rows = rows.select(*keys, _label(df, x).alias("category"), _label(df, color).alias("color"), *carried)
    group = [*keys, "category", "color"]
    if agg == "median":
        cells = grouped_stats(rows, group, y, [0.5], extra=[F.count(F.lit(1)).alias("n")], null_keys=["color"])
        cells = cells.select(*group, F.get("q", F.lit(0)).alias("value"), "n")
    else:
        cells = rows.groupBy(*group).agg(_aggregate(agg, y).alias("value"), F.count(F.lit(1)).alias("n"))
    cells = materialize(cells)  # one row per cell: read for shares, the axis and the colours
    if agg == "share":
        whole = cells.groupBy(*keys, "color").agg(F.sum("n").alias("__total"))
        cells = join_on(cells, whole, [*keys, "color"], null_keys=["color"])
        cells = cells.withColumn("value", F.round(ratio(F.col("n") * 100, F.col("__total")), 3)).drop("__total")
    axis_keys = [] if shared_axis else list(keys)
    axis = top_labels(cells.groupBy(*axis_keys, "category").agg(F.sum("n").alias("total")), CATEGORY_LABELS,
                      "category", keys=axis_keys).drop("total")
    shown = _on_axis(cells, axis, axis_keys)
    if color:
        shown = join_on(shown, first_colors(cells, keys), [*keys, "color"], null_keys=["color"]).drop("color_rank")
    return shown.select(*keys, "color", "category", "axis", finite(F.col("value")).alias("value"), "n")


def box(df: DataFrame, x: str, y: str, color: str | None = None, filters: list[dict] | None = None, *,
        keys: Seq[str] = (), shared_axis: bool = False) -> DataFrame:
    """Box statistics of y per (series, category, colour)."""
    require_columns(df, x, color)
    require_numeric(df, y)
    rows = apply_filters(df, filters).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select(*keys, _label(df, x).alias("category"), _label(df, color).alias("color"), F.col(y).alias("__y"))
    stats = materialize(box_stats(rows, [*keys, "category", "color"], "__y", null_keys=["color"]).drop("min", "max"))
    guard_cardinality(stats, keys, BOX_CARDINALITY if shared_axis else BOX_COLOR_CARDINALITY)
    axis_keys = [] if shared_axis else list(keys)
    axis = top_labels(stats.groupBy(*axis_keys, "category").agg(F.sum("count").alias("total")), CATEGORY_LABELS,
                      "category", keys=axis_keys).drop("total")
    shown = _on_axis(stats, axis, axis_keys)
    if color:
        shown = join_on(shown, first_colors(stats, keys), [*keys, "color"], null_keys=["color"]).drop("color_rank")
    return shown


def histogram_by_color(df: DataFrame, x: str, color: str | None = None, bins: int = 40,
                       filters: list[dict] | None = None) -> DataFrame:
    """Counts and percents within each colour. Numeric x: shared, zero-filled bins. Otherwise: top-40 labels in
    count order, percents over all labels of the colour."""
    require_columns(df, x, color)
    rows = apply_filters(df, filters)
    if kind_of(dtype_of(df, x)) != "numeric":
        cells = rows.groupBy(_label(df, x).alias("label"), _label(df, color).alias("color")).agg(
            F.count(F.lit(1)).alias("count"))
        cells = materialize(cells)
        axis = top_labels(cells.groupBy("label").agg(F.sum("count").alias("total")), CATEGORY_LABELS,
                          numeric_order=None).drop("total")
        whole = cells.groupBy("color").agg(F.sum("count").alias("__n"))
        colors = join_on(whole, first_colors(cells, ()), ["color"], null_keys=["color"])
        grid = repeat_for(colors, axis)  # at most 8 x 40
        filled = join_on(grid, cells, ["color", "label"], "left", null_keys=["color", "label"])
        filled = filled.withColumn("count", F.coalesce("count", F.lit(0)))
        return filled.select("color", "label", "axis", "count",
                             F.round(ratio(F.col("count") * 100, F.col("__n")), 3).alias("percent"))
    n = clamp_bins(bins)
    present = rows.filter(F.col(x).isNotNull()).select(x, _label(df, color).alias("color"))
    ranges = value_range(present, [x], [n])
    binned = beside(present, ranges).groupBy(bin_of(x, 0, n).alias("bin"), "color")
    cells = materialize(binned.agg(F.count(F.lit(1)).alias("count")))
    colors = first_colors(cells, ()).drop("color_rank")
    grid = repeat_for(colors, bin_grid(ranges, n))  # at most 8 x 200
    filled = join_on(grid, cells, ["color", "bin"], "left", null_keys=["color"])
    return percent_within(filled.withColumn("count", F.coalesce("count", F.lit(0))), ["color"], "count", "percent", 3)


def points(df: DataFrame, kind: str, x: str, y: str, color: str | None = None, filters: list[dict] | None = None,
           max_points: int | None = None, *, keys: Seq[str] = (), tie: str | Seq[str] = "row_pos",
           limit: int | None = None) -> DataFrame:
    """Scatter points in recorded order or line points in the order of x, thinned by stride per series."""
    require_columns(df, x, color)
    require_numeric(df, y)
    ties = [tie] if isinstance(tie, str) else list(tie)
    rows = apply_filters(df, filters).select(*dict.fromkeys([*keys, x, y, *([color] if color else []), *ties]))
    order = ([x] if kind == "line" else []) + ties
    if not keys:
        rows = rows.withColumn("__all", F.lit(0))
    out = every_stride(rows, list(keys) or ["__all"], order, limit or clamp_points(max_points))
    return out.drop("__all")


def heatmap(df: DataFrame, x: str, y: str, bins: int = 40, filters: list[dict] | None = None) -> DataFrame:
    return density(df, x, y, bins, filters=filters)


# -- group mode: the series are named groups of recordings ------------------------------------------


def group_members(groups: dict[str, Seq[str]], spark) -> DataFrame:
    """(label, dataset_id) rows of at most 8 named groups; a recording may be in several."""
    require(bool(groups), "give at least one group")
    require(len(groups) <= CHART_GROUPS, f"at most {CHART_GROUPS} groups")
    for label, ids in groups.items():
        require(bool(ids), f"group {label} has no recordings")
    return spark.createDataFrame([(g, i) for g, ids in groups.items() for i in ids], "label string, dataset_id string")


def pooled(df: DataFrame, members: DataFrame, columns: Seq[str], key: str = "dataset_id") -> DataFrame:
    """Rows of the needed columns with the label of every group their recording belongs to."""
    require_columns(df, *columns)
    rows = df.select(*dict.fromkeys([key, *columns]))
    return lookup(rows, members.select(key, "label"), [key])


def _filter_columns(filters: list[dict] | None) -> list[str]:
    return [f["column"] for f in filters or []]


def group_bar(df, members, x, y=None, agg="avg", filters=None) -> DataFrame:
    needed = [x, *([y] if agg not in ("count", "share") else []), *_filter_columns(filters)]
    return bar(pooled(df, members, needed), x, y, None, agg, filters, keys=["label"], shared_axis=True).drop("color")


def group_box(df, members, x, y, filters=None) -> DataFrame:
    rows = pooled(df, members, [x, y, *_filter_columns(filters)])
    return box(rows, x, y, None, filters, keys=["label"], shared_axis=True).drop("color")


def group_histogram(df, members, x, bins=40, filters=None) -> DataFrame:
    """Counts and percents of each group over shared edges, or over the shared top-40 labels."""
    rows = apply_filters(pooled(df, members, [x, *_filter_columns(filters)]), filters)
    series = members.select("label").distinct()
    if kind_of(dtype_of(df, x)) != "numeric":
        cells = rows.groupBy("label", _label(df, x).alias("category")).agg(F.count(F.lit(1)).alias("count"))
        cells = materialize(cells)
        axis = top_labels(cells.groupBy("category").agg(F.sum("count").alias("total")), CATEGORY_LABELS,
                          "category").drop("total")
        sizes = cells.groupBy("label").agg(F.sum("count").alias("__n"))
        grid = repeat_for(series, axis).join(sizes, "label", "left")  # at most 8 x 40
        filled = join_on(grid, cells, ["label", "category"], "left", null_keys=["category"])
        filled = filled.withColumn("count", F.coalesce("count", F.lit(0)))
        share = F.coalesce(F.round(ratio(F.col("count") * 100, F.col("__n")), 3), F.lit(0.0))
        return filled.select("label", "category", "axis", "count", share.alias("percent"))
    n = clamp_bins(bins)
    present = rows.filter(F.col(x).isNotNull())
    ranges = value_range(present, [x], [n])
    cells = beside(present, ranges).groupBy("label", bin_of(x, 0, n).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    grid = repeat_for(series, bin_grid(ranges, n))  # at most 8 x 200
    filled = grid.join(cells, ["label", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return percent_within(filled, ["label"], "count", "percent", 3)


def group_heatmap(df, members, x, y, bins=40, filters=None) -> DataFrame:
    """Sparse cells of each group over shared edges, with the percent inside the group."""
    rows = pooled(df, members, [x, y, *_filter_columns(filters)])
    return percent_within(density(rows, x, y, bins, filters=filters, keys=["label"]), ["label"], "count", "percent", 5)


def group_points(df, members, kind, x, y, filters=None, max_points=None, *, tie="row_pos") -> DataFrame:
    """Points of each group; the point budget is shared by the groups."""
    n_groups = members.select("label").distinct().count()
    limit = max(POINTS_PER_SERIES_MIN, clamp_points(max_points) // max(1, n_groups))
    rows = pooled(df, members, [x, y, tie, *_filter_columns(filters)])
    return points(rows, kind, x, y, None, filters, keys=["label"], tie=("dataset_id", tie), limit=limit)


def group_stats(df, members, column, filters=None) -> DataFrame:
    require_numeric(df, column)
    rows = apply_filters(pooled(df, members, [column, *_filter_columns(filters)]), filters)
    stats = grouped_stats(rows, ["label"], column, [0.5])
    every = members.select("label").distinct().join(stats, "label", "left")  # groups that the filters empty stay
    return every.select("label", F.coalesce("count", F.lit(0)).alias("count"), "avg", "std", "min", "max", F.get("q", F.lit(0)).alias("median"))
