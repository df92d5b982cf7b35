"""Two runs on one axis: signals with resolved names, a time offset found from the signals, or course progress."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from collections.abc import Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import OFFSET_GRID, OFFSET_OVERLAP, OFFSET_SIGNAL_NAME, OFFSET_WEAK_SCORE
from ..functions.scalars import finite
from ..limits import require
from ..session import materialize
from .asof import resample, uniform_grid
from .filters import resolvable_filters
from .frames import lookup
from .sampling import timeseries
from .schema import align_names, dtype_of, kind_of, resolve_column


def offset_signal(names: Seq[str]) -> str:
    """The signal to align by: the first that looks like speed or engine speed, else the first."""
    return next((n for n in names if re.search(OFFSET_SIGNAL_NAME, n, re.IGNORECASE)), names[0])


def _best_lag(a: np.ndarray, b: np.ndarray, a_start: float, b_start: float, dt: float) -> tuple | None:
    low, high = b.min(), b.max()
    first, last = 0, len(b) - 1
    if high > low:  # leave out the standing stretches at both ends of b
        busy = np.flatnonzero(b >= low + (high - low) * 0.1)
        first, last = int(busy[0]), int(busy[-1])
    part = b[first:last + 1]
    if len(part) < 4:
        return None
    za, zb = a - a.mean(), part - part.mean()
    na, nb = len(za), len(zb)
    least = max(8, math.floor(nb * OFFSET_OVERLAP))
    lags = np.arange(-(nb - least), na - least + 1)
    lags = lags[(np.minimum(nb, na - lags) - np.maximum(0, -lags)) >= least]
    if not len(lags):
        return None
    dots = np.correlate(za, zb, mode="full")[lags + nb - 1]
    from_b, to_b = np.maximum(0, -lags), np.minimum(nb, na - lags)
    sum_a, sum_b = np.r_[0, np.cumsum(za * za)], np.r_[0, np.cumsum(zb * zb)]
    scale = np.sqrt((sum_a[to_b + lags] - sum_a[from_b + lags]) * (sum_b[to_b] - sum_b[from_b]))
    scores = np.divide(dots, scale, out=np.zeros(len(lags)), where=scale > 0)
    best = int(scores.argmax())
    offset = (a_start - (b_start + first * dt)) + lags[best] * dt
    offset = float(math.floor(offset + 0.5)) if abs(offset) >= 100 else round(float(offset), 3)
    return offset, max(0.0, float(scores[best]))


def _fit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            found = _best_lag(np.asarray(r.a, float), np.asarray(r.b, float), r.a_lo, r.b_lo, r.dt)
            if found:
                rows.append((r.pair, found[0], found[1], found[1] < OFFSET_WEAK_SCORE))
        yield pd.DataFrame(rows, columns=["pair", "offset", "score", "weak"])


def best_offset(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, offset, score, weak): the time to add to run B so that its signal fits run A best.

    Inputs (pair, row_pos, t, y) of any length. Both runs are brought to a common step of 1/600 of the longer
    one by window interpolation; only those grids (at most 601 values) reach the correlation.
    """
    sides = {}
    for name, df in (("a", a), ("b", b)):
        clean = df.select("pair", "row_pos", finite(F.col("t")).alias("t"), finite(F.col("y")).alias("y"))
        sides[name] = clean.filter(F.col("t").isNotNull() & F.col("y").isNotNull())
    spans = [df.groupBy("pair").agg(F.min("t").alias(f"{n}_lo"), (F.max("t") - F.min("t")).alias(f"{n}_span"),
                                    F.count(F.lit(1)).alias(f"{n}_n")) for n, df in sides.items()]
    usable = spans[0].join(spans[1], "pair").filter(
        (F.col("a_n") >= 4) & (F.col("b_n") >= 4) & (F.col("a_span") > 0) & (F.col("b_span") > 0))
    steps = usable.select("pair", "a_lo", "b_lo", (F.greatest("a_span", "b_span") / OFFSET_GRID).alias("dt"))
    steps = materialize(steps)  # one row per pair, used for both grids
    fit = steps
    for name, df in sides.items():
        grid = uniform_grid(df, ["pair"], steps.select("pair", "dt"), written=True)
        values = resample(lookup(df, steps.select("pair"), ["pair"], written=True), grid, ["pair"])
        arrays = values.groupBy("pair").agg(  # at most 601 grid points
            F.transform(F.array_sort(F.collect_list(F.struct("g", "y"))), lambda s: s["y"]).alias(name))
        fit = fit.join(arrays, "pair")
    schema = f"pair {dtype_of(a, 'pair').simpleString()}, offset double, score double, weak boolean"
    return fit.mapInPandas(_fit_batches, schema)


def overlay_runs(run_a: DataFrame, run_b: DataFrame | None, x: str, ys: Seq[str], filters: list[dict] | None = None,
                 aliases: list[tuple[str, str]] = (), *, offset: float = 0.0, by_signal: bool = False,
                 max_points: int | None = None) -> DataFrame:
    """Sampled points of both runs under run A's names: (run, x, signals, rn, total_rows, stride).

    Run B's columns are found by name or alias, filters on columns it lacks are dropped, and its numeric time is
    shifted by `offset` unless x is a reference signal. A run B without the x column or any signal is left out.
    """
    ys = [y for y in ys if y != x]
    require(bool(ys), "choose at least one signal to compare")

    def sampled(df: DataFrame, label: str, shift: float) -> DataFrame | None:
        if resolve_column(x, df.columns, list(aliases)) is None:
            return None
        own_filters = resolvable_filters(filters, df.columns, list(aliases))
        renamed, served = align_names(df, [x, *ys], list(aliases))
        numeric = [y for y in served if y != x and kind_of(dtype_of(renamed, y)) == "numeric"]
        if not numeric:
            return None
        extra = [F.col(f["column"]).alias(f"__f_{i}") for i, f in enumerate(own_filters)]
        both = df.select("dataset_id", "row_pos", *[
            F.col(resolve_column(c, df.columns, list(aliases))).alias(c) for c in [x, *numeric]], *extra)
        moved = [{**f, "column": f"__f_{i}"} for i, f in enumerate(own_filters)]
        out = timeseries(both, x, numeric, moved, max_points)
        if shift and kind_of(dtype_of(out, x)) == "numeric":
            out = out.withColumn(x, F.col(x) + F.lit(float(shift)))
        return out.select(F.lit(label).alias("run"), "dataset_id", x, *numeric, "rn", "total_rows", "stride")

    first = sampled(run_a, "a", 0.0)
    require(first is not None, "run A lacks the axis column or the signals")
    second = sampled(run_b, "b", 0.0 if by_signal else float(offset)) if run_b is not None else None
    return first if second is None else first.unionByName(second, allowMissingColumns=True)
