"""Events (runs of a state) and state transitions along every recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import category, epoch_seconds, ratio
from ..limits import EVENTS_PER_DATASET, require
from ..session import materialize
from .cohorts import describe_values, only_members
from .filters import apply_filters
from .frames import repeat_for, require_columns
from .ordered import Ordered
from .sampling import top_rows
from .schema import dtype_of, require_numeric, require_orderable


def _states(df: DataFrame, state: str, order_by: str, filters, extra: dict, key: str, tie: str) -> DataFrame:
    """Filtered rows with a state and an order; rows filtered out do not break a run."""
    require(state != order_by, "state and order must be different columns")
    require_columns(df, state, order_by)
    require_orderable(df, order_by)
    rows = apply_filters(df, filters).filter(F.col(state).isNotNull() & F.col(order_by).isNotNull())
    return rows.select(key, F.col(order_by).alias("__order"), F.col(tie).alias("__tie"),
                       category(F.col(state), dtype_of(df, state)).alias("state"),
                       *[c.alias(n) for n, c in extra.items()])


def state_runs(df: DataFrame, state: str, order_by: str, time_column: str | None = None,
               secondary: str | None = None, filters: list[dict] | None = None, *, key: str = "dataset_id",
               tie: str = "row_pos") -> DataFrame:
    """All maximal runs of equal state: (key, run, state, start, duration, rows, secondary)."""
    time_column = time_column or order_by
    require_columns(df, time_column, secondary)
    require_orderable(df, time_column)
    if secondary:
        require_numeric(df, secondary)
    extra = {"t": epoch_seconds(F.col(time_column), dtype_of(df, time_column)),
             "second": F.col(secondary).cast("double") if secondary else F.lit(None).cast("double")}
    rows = _states(df, state, order_by, filters, extra, key, tie)
    steps = Ordered(rows, [key], ["__order", "__tie"]).lag({"previous": "state"})
    change = F.when(F.col("previous").isNull() | (F.col("previous") != F.col("state")), 1).otherwise(0)
    runs = steps.running_sum({"run": change}).df
    return runs.groupBy(key, "run", "state").agg(
        F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("duration"),
        F.count(F.lit(1)).alias("rows"), F.avg("second").alias("secondary"))


def events(df: DataFrame, state: str, value: str, order_by: str, time_column: str | None = None,
           secondary: str | None = None, filters: list[dict] | None = None, *, key: str = "dataset_id",
           tie: str = "row_pos", per_dataset: int | None = EVENTS_PER_DATASET) -> DataFrame:
    """Runs of one state value, at most `per_dataset` per recording by start (None keeps all).

    The value is compared as text: '1' does not match a double state 1.0.
    """
    value = str(value).strip()
    require(bool(value), "give the state value of an event")
    require(time_column is None or time_column != state, "state and time must be different columns")
    runs = state_runs(df, state, order_by, time_column, secondary, filters, key=key, tie=tie)
    found = runs.filter(F.col("state") == value).drop("state")
    if per_dataset is None:
        return found
    return top_rows(found, [key], [F.col("start").asc_nulls_last(), F.col("run").asc()], per_dataset, "event",
                    spread="run")


def event_summary(df: DataFrame, members: DataFrame, state: str, value: str, order_by: str,
                  time_column: str | None = None, secondary: str | None = None,
                  filters: list[dict] | None = None, *, key: str = "dataset_id", tie: str = "row_pos") -> DataFrame:
    """Per cohort: number of events, events per 1000 source rows and statistics of their durations."""
    rows = only_members(df, members, key)
    found = events(rows, state, value, order_by, time_column, secondary, filters, key=key, tie=tie, per_dataset=None)
    pairs = members.select("cohort", key)
    durations = materialize(found.join(pairs, key).select("cohort", "duration", "secondary"))  # one row per event
    stats = describe_values(durations, ["cohort"], "duration", p90=True)
    counted = durations.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("event_count"), F.avg("secondary").alias("secondary_mean"))
    source = _states(rows, state, order_by, filters, {}, key, tie).groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    sizes = source.join(pairs, key).groupBy("cohort").agg(F.sum("c").alias("source_rows"))
    out = members.select("cohort").distinct().join(sizes, "cohort", "left").join(counted, "cohort", "left")
    out = out.join(stats, "cohort", "left")
    number = F.coalesce("event_count", F.lit(0))
    return out.withColumn("event_count", number).withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "events_per_1k_rows", F.round(ratio(number * 1000, F.col("source_rows")), 3))


def transitions(df: DataFrame, state: str, order_by: str, filters: list[dict] | None = None, *,
                key: str = "dataset_id", tie: str = "row_pos") -> DataFrame:
    """(key, previous, state, count) of every change of state."""
    rows = _states(df, state, order_by, filters, {}, key, tie)
    steps = Ordered(rows, [key], ["__order", "__tie"]).lag({"previous": "state"}).df
    changes = steps.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("state")))
    return changes.groupBy(key, "previous", "state").agg(F.count(F.lit(1)).alias("count"))


def transition_rates(df: DataFrame, members: DataFrame, state: str, order_by: str,
                     filters: list[dict] | None = None, denominator: str | None = None, scale: float = 1.0, *,
                     key: str = "dataset_id", tie: str = "row_pos") -> DataFrame:
    """Transitions of each cohort with pooled and equal-weight rates, zero-filled over all labels.

    The denominator is 1000 rows, or the span of a column times a user scale.
    """
    require(scale > 0, "the scale must be positive")
    if denominator:
        require_numeric(df, denominator)
    rows = only_members(df, members, key)
    label = F.concat_ws("→", "previous", "state")
    counts = transitions(rows, state, order_by, filters, key=key, tie=tie)
    counts = materialize(counts.select(key, label.alias("transition"), "count"))  # read for cells and labels
    extra = {"d": F.col(denominator).cast("double")} if denominator else {}
    source = _states(rows, state, order_by, filters, extra, key, tie)
    span = F.coalesce(F.max("d") - F.min("d"), F.lit(0.0)) if denominator else F.count(F.lit(1)).cast("double")
    sizes = source.groupBy(key).agg(span.alias("den"), F.count(F.lit(1)).alias("source_rows"))
    factor = F.lit(float(scale) if denominator else 1000.0)
    pairs = members.select("cohort", key)
    sized = pairs.join(sizes, key, "left")
    cohort = sized.groupBy("cohort").agg(
        F.coalesce(F.sum("den"), F.lit(0.0)).alias("den"), F.count(F.lit(1)).alias("members"),
        F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"))
    rate = F.when(F.col("den") > 0, F.col("count") * factor / F.col("den")).otherwise(0.0)
    cells = counts.join(sized, key).groupBy("cohort", "transition").agg(
        F.sum("count").alias("count"), F.sum(rate).alias("rates"))
    order = counts.groupBy("transition").agg(F.sum("count").alias("total"))
    grid = repeat_for(order, cohort).join(cells, ["cohort", "transition"], "left")  # one row per result cell
    count = F.coalesce("count", F.lit(0))
    return grid.select(
        "cohort", "transition", "total", count.alias("count"), "source_rows",
        F.round(F.when(F.col("den") > 0, count * factor / F.col("den")), 6).alias("pooled_rate"),
        F.round(F.coalesce("rates", F.lit(0.0)) / F.col("members"), 6).alias("mean_rate"))
