"""Welch power spectra per cohort.

A row belongs to at most two overlapping segments, so a recording is cut into segments of 1024 rows that are
transformed independently: a long recording is spread over the cluster and no row limit is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import DEFAULT_BAND
from ..functions.scalars import epoch_seconds, ratio
from ..limits import SPECTRUM_GRID, SPECTRUM_MIN_ROWS, SPECTRUM_SEGMENT, require
from ..session import materialize
from .cohorts import only_members, with_every_cohort
from .filters import apply_filters
from .frames import beside, lookup
from .ordered import Ordered
from .quantiles import quantiles
from .schema import dtype_of, require_numeric, require_orderable


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def segment_power(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """One-sided power density of one segment: mean removed, periodic Hann window, scaled by the sampling rate."""
    for segments, rates in batches:
        out = []
        for values, rate in zip(segments, rates):
            v = np.asarray(values, dtype=float)
            n = len(v)
            taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
            power = np.abs(np.fft.rfft((v - v.mean()) * taper)) ** 2 / (rate * (taper ** 2).sum())
            power[1:(n + 1) // 2] *= 2  # every bin but zero and, for even n, the last
            out.append(power)
        yield pd.Series(out)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def on_grid(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A recording's density interpolated on the common grid 0..limit."""
    for densities, rates, sizes, limits in batches:
        out = []
        for density, rate, size, limit in zip(densities, rates, sizes, limits):
            at = np.linspace(0.0, limit, SPECTRUM_GRID)
            own = np.arange(len(density)) * (rate / size)  # an odd segment ends below half the rate
            out.append(np.interp(at, own, np.asarray(density, dtype=float), left=0.0, right=0.0))
        yield pd.Series(out)


def welch(df: DataFrame, signal: str, order_by: str, filters: list[dict] | None = None, *, key: str = "dataset_id",
          tie: str = "row_pos") -> DataFrame:
    """(key, rate, size, density ARRAY<DOUBLE>), size being the rows of a segment, for recordings with at least 32 rows and a positive median time step."""
    require(signal != order_by, "signal and time must be different columns")
    require_numeric(df, signal)
    require_orderable(df, order_by)
    t = epoch_seconds(F.col(order_by), dtype_of(df, order_by))
    rows = apply_filters(df, filters).filter(F.col(signal).isNotNull() & F.col(order_by).isNotNull())
    rows = rows.select(key, F.col(order_by).alias("__order"), F.col(tie).alias("__tie"), t.alias("t"),
                       F.col(signal).cast("double").alias("v"))
    numbered = Ordered(rows, [key], ["__order", "__tie"]).row_number("rn", "n").lag({"t_prev": "t"}).df
    numbered = materialize(numbered.filter(F.col("n") >= SPECTRUM_MIN_ROWS).select(key, "rn", "n", "t", "t_prev", "v"))
    steps = numbered.filter(F.col("t_prev").isNotNull()).select(key, (F.col("t") - F.col("t_prev")).alias("dt"))
    step = quantiles(steps, [key], "dt", [0.5], "q").select(key, F.get("q", F.lit(0)).alias("dt"))
    rates = step.filter(F.col("dt") > 0).select(key, (1.0 / F.col("dt")).alias("rate"))
    size = F.least(F.col("n"), F.lit(SPECTRUM_SEGMENT))
    hop = size - F.floor(size / 2)
    i = F.col("rn") - 1
    last = F.floor((F.col("n") - size) / hop)
    first_of = F.greatest(F.floor((i - size) / hop) + 1, F.lit(0))
    last_of = F.least(F.floor(i / hop), last)
    member = F.when(first_of <= last_of, F.sequence(first_of, last_of))
    cut = numbered.select(key, "rn", "v", size.alias("size"), F.explode(member).alias("segment"))
    segments = cut.groupBy(key, "size", "segment").agg(  # at most 1024 rows
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "v"))), lambda s: s["v"]).alias("values"))
    powers = lookup(segments, rates, [key]).select(key, "rate", "size", segment_power("values", "rate").alias("p"))
    bins = powers.select(key, "rate", "size", F.posexplode("p").alias("bin", "power"))
    means = bins.groupBy(key, "rate", "size", "bin").agg(F.avg("power").alias("power"))
    return means.groupBy(key, "rate", "size").agg(  # at most 513 frequencies
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "power"))), lambda s: s["power"]).alias("density"))


def cohort_spectrum(df: DataFrame, members: DataFrame, signal: str, order_by: str,
                    filters: list[dict] | None = None, band: tuple[float, float] = DEFAULT_BAND, *,
                    key: str = "dataset_id", tie: str = "row_pos") -> DataFrame:
    """(cohort, bin, freq, psd, band_power, band_ratio): mean density of the recordings on a 256-point grid up to
    the smallest Nyquist frequency, and the energy inside the band. A cohort without a usable recording has one row of nulls.
    """
    densities = materialize(welch(only_members(df, members, key), signal, order_by, filters, key=key, tie=tie))
    limit = densities.agg((F.min("rate") / 2).alias("limit"))
    grids = beside(densities, limit).select(
        key, "limit", on_grid("density", "rate", "size", "limit").alias("g"))
    points = grids.select(key, "limit", F.posexplode("g").alias("bin", "p"))
    mean = points.join(members.select("cohort", key), key).groupBy("cohort", "bin").agg(
        F.avg("p").alias("p"), F.first("limit").alias("limit"))
    freq = F.col("limit") * F.col("bin") / F.lit(SPECTRUM_GRID - 1)
    w = Window.partitionBy("cohort").orderBy("bin")  # 256 rows per cohort
    lo, hi = F.lit(float(band[0])), F.lit(float(band[1]))
    curve = mean.withColumn("freq", freq).withColumn("__inside", F.col("freq").between(lo, hi))
    area = (F.col("p") + F.lag("p").over(w)) / 2 * (F.col("freq") - F.lag("freq").over(w))
    in_band = F.col("__inside") & F.lag("__inside").over(w)
    curve = curve.withColumn("__area", area).withColumn("__band", F.when(in_band, area).otherwise(0.0))
    whole = Window.partitionBy("cohort")
    power, total = F.sum("__band").over(whole), F.sum("__area").over(whole)
    found = curve.select("cohort", "bin", F.round("freq", 4).alias("freq"), F.round("p", 8).alias("psd"),
                        F.round(power, 8).alias("band_power"),
                        F.when(total > 0, F.round(ratio(power, total), 5)).alias("band_ratio"))
    return with_every_cohort(found, members)
