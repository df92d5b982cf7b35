"""Signal rows joined with the positions of their drive, for many pairs in one job."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, recording_start
from ..limits import clamp_points, require
from .asof import align
from .filters import apply_filters
from .frames import lookup
from .ordered import Ordered
from .routes import coordinate_stats, latitude_first, looks_like_degrees, swap_roles
from .schema import (
    coordinate_axes,
    coordinate_columns,
    dtype_of,
    elapsed_column,
    kind_of,
    name_kinds,
    require_numeric,
    time_column,
)


def absolute_seconds(df: DataFrame, file_name: str | None = None) -> Column | None:
    """Seconds on a shared clock: the first temporal column, else an elapsed column plus the start time in the
    file name (a column when the frame has one of that name, else a literal). None when neither exists."""
    fields = name_kinds(df)
    temporal = next((n for n, k in fields if k == "temporal"), None)
    if temporal:
        return epoch_seconds(F.col(temporal), dtype_of(df, temporal))
    elapsed = elapsed_column(fields)
    if not elapsed or not file_name:
        return None
    name = F.col(file_name) if file_name in df.columns else F.lit(file_name)
    return F.unix_micros(recording_start(name).cast("timestamp")) / F.lit(1e6) + F.col(elapsed).cast("double")


def join_track(signal: DataFrame, gps: DataFrame, signals: Seq[str], coords: Seq[str], *, keys: Seq[str] = ("pair",),
               x: str | None = None, filters: list[dict] | None = None, max_points: int | None = None,
               signal_seconds: Column | None = None, gps_seconds: Column | None = None,
               same_log: bool = False, pos: str = "row_pos") -> DataFrame:
    """Sampled rows (keys, row_pos, signals, coords, align_mode, total_rows, stride) of each pair.

    Pairs are aligned by nearest time when both clocks are known and agree, else by row position. The stride
    counts filtered signal rows; the total counts joined rows.
    """
    columns = list(dict.fromkeys(c for c in [x, *signals] if c))
    clash = set(columns) & set(coords) - {*keys, pos}
    require(not clash or same_log, f"signal and position columns share names: {sorted(clash)}")
    rows = apply_filters(signal, filters)
    timed = signal_seconds is not None and gps_seconds is not None and not same_log
    rows = rows.select(*keys, pos, *[c for c in columns if c not in (*keys, pos)],
                       *([signal_seconds.alias("__t")] if timed else []))
    spots = gps.select(*keys, F.col(pos).alias("right_pos"), *[F.col(c).alias(f"__g_{c}") for c in coords],
                       *([gps_seconds.alias("__t")] if timed else []))
    if timed:
        probe = spots.select(*keys, F.col("right_pos").alias(pos), F.col("__t"))
        mapping = align(rows.select(*keys, pos, "__t"), probe, keys, time="__t", pos=pos)
        matched = rows.drop("__t").join(mapping, [*keys, pos])
    else:
        matched = rows.withColumn("right_pos", F.col(pos)).withColumn(
            "align_mode", F.lit("self" if same_log else "rowid"))
    joined = matched.join(spots.drop("__t"), [*keys, "right_pos"])
    totals = joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"))
    numbers = Ordered(rows.select(*keys, pos), keys, [pos]).row_number("__rn").df
    stride = F.greatest(F.lit(1), F.ceil(F.col("total_rows") / F.lit(clamp_points(max_points)))).cast("long")
    kept = lookup(numbers, totals, keys).withColumn("stride", stride).filter(
        (F.col("__rn") - 1) % F.col("stride") == 0).drop("__rn")
    out = joined.join(kept, [*keys, pos])
    return out.select(*keys, pos, *[c for c in columns if c not in (*keys, pos)],
                      *[F.col(f"__g_{c}").alias(c) for c in coords if c not in columns],
                      "align_mode", "total_rows", "stride")


def choose_axes(sample: DataFrame, fields: list[tuple[str, str]], lat_col: str | None = None,
                lon_col: str | None = None) -> dict:
    """Which columns of one track are horizontal, what they mean and which one is the altitude.

    Decided on the driver from one aggregate row: {mode, x, y, altitude}; x is longitude in geographic mode.
    """
    axes = coordinate_axes(fields)
    if lat_col and lon_col:
        coords, named = [lat_col, lon_col], True
    else:
        kind, coords = coordinate_columns(fields)
        require(kind != "none", "no coordinate columns found; name them")
        named = kind == "latlon"
    stats = coordinate_stats(sample, [], coords)
    number = {c: tuple(F.col(f"{part}_{i}").cast("double") for part in ("min", "max", "mean")) for i, c in enumerate(coords)}
    far = {c: F.greatest(F.abs(n[0]), F.abs(n[1])) for c, n in number.items()}
    tests = {}  # every question about a pair of axes, answered beside the aggregate
    for p, q in permutations(coords, 2):
        tests["degrees", p, q] = looks_like_degrees(*number[p], *number[q])
        tests["swap", p, q] = swap_roles(far[p], far[q])
        tests["first", p, q] = latitude_first(far[p], number[p][2], far[q], number[q][2])
    row = stats.select("*", *[t.alias(f"__test_{i}") for i, t in enumerate(tests.values())]).first()  # one row
    stat = {c: (row[f"min_{i}"], row[f"max_{i}"]) for i, c in enumerate(coords)}
    answers = {name: bool(row[f"__test_{i}"]) for i, name in enumerate(tests)}

    lon = lat = None
    if not named and "x" in axes and "y" in axes and {axes["x"], axes["y"]} <= set(coords):
        a, b = lon, lat = axes["x"], axes["y"]
    elif named:
        a, b = lat, lon = coords[0], coords[1]
    else:
        found = next(((p, q) for p, q in combinations(coords, 2) if answers["degrees", p, q]), None)
        if found:
            a, b = found
        else:
            width = {c: (s[1] - s[0]) if s[0] is not None else 0.0 for c, s in stat.items()}
            widest = sorted(coords, key=lambda c: -width[c])[:2]
            a, b = sorted(widest, key=coords.index)
    altitude = next((axes[k] for k in "zyx" if axes.get(k) and axes[k] not in coords), None) or next(
        (c for c in coords if c not in (a, b)), None)
    if not answers["degrees", a, b]:
        return {"mode": "planar", "x": a, "y": b, "altitude": altitude}
    if lat and lon:
        if answers["swap", lat, lon]:
            lat, lon = lon, lat
    else:
        lat, lon = (a, b) if answers["first", a, b] else (b, a)
    return {"mode": "geographic", "x": lon, "y": lat, "altitude": altitude}


def map_track(signal: DataFrame, gps: DataFrame, signals: Seq[str] = (), *, color_signal: str | None = None,
              x: str | None = None, lat_col: str | None = None, lon_col: str | None = None,
              filters: list[dict] | None = None, max_points: int | None = None, same_log: bool = False,
              signal_name: str | None = None, gps_name: str | None = None,
              keys: Seq[str] = ("pair",)) -> tuple[DataFrame, dict]:
    """One pair's sampled track with columns x, y and altitude named by the axes that were chosen."""
    chosen = [*dict.fromkeys([*signals, *([color_signal] if color_signal else [])])]
    if chosen:
        require_numeric(signal, *chosen)
    fields = [(n, k) for n, k in name_kinds(gps) if n not in keys]
    x = x or time_column([(n, k) for n, k in name_kinds(signal) if n not in keys])
    if lat_col and lon_col:
        require_numeric(gps, lat_col, lon_col)
        coords = [lat_col, lon_col]
    else:
        coords = coordinate_columns(fields)[1]
        require(bool(coords), "no coordinate columns found; name them")
    axes = coordinate_axes(fields)
    extra = next((axes[k] for k in "zyx" if axes.get(k) and axes[k] not in coords), None)
    coords = [*coords, *([extra] if extra else [])]
    clash = [c for c in coords if c in [x, *chosen]]
    rows = join_track(
        signal, gps.withColumnsRenamed({c: f"gps_{c}" for c in clash}) if clash and not same_log else gps, chosen,
        [f"gps_{c}" if c in clash and not same_log else c for c in coords], keys=keys, x=x, filters=filters,
        max_points=max_points, signal_seconds=absolute_seconds(signal, signal_name),
        gps_seconds=absolute_seconds(gps, gps_name), same_log=same_log)
    names = {c: f"gps_{c}" if c in clash and not same_log else c for c in coords}
    sample = rows.select(*[F.col(n).alias(c) for c, n in names.items()])
    roles = choose_axes(sample, fields, lat_col, lon_col)
    out = rows.withColumn("track_x", F.col(names[roles["x"]]).cast("double")).withColumn(
        "track_y", F.col(names[roles["y"]]).cast("double"))
    if roles["altitude"] and roles["altitude"] in names:
        out = out.withColumn("altitude", F.col(names[roles["altitude"]]))
    return out, {**roles, "x_axis": x}


__all__ = ["absolute_seconds", "choose_axes", "join_track", "kind_of", "map_track"]
