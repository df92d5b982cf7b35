"""Course geometry of a drive: elapsed time, bad-position detection, gap filling, progress and course matching."""

from __future__ import annotations

import math
from collections.abc import Iterator
from collections.abc import Sequence as Seq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import (
    COURSE_EARTH_RADIUS_M,
    COURSE_SEARCH_FACTOR,
    COURSE_SEARCH_MIN,
    FROZEN_COORD_EPSILON,
    FROZEN_MIN_SPEED,
    MIN_TIME_STEP,
    ORIGIN_EPSILON,
)
from ..functions.scalars import epoch_seconds, finite, plain_number
from ..limits import require
from ..session import materialize
from .frames import join_on
from .ordered import Ordered
from .schema import dtype_of, kind_of


_TEXT_TIME = r"^\d{4}-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d*)?)?\s*(Z|[+-]\d{1,2}:\d{2})?)?)?$"


def _text_times(text: Column) -> tuple[Column, Column]:
    """Seconds since 1970 that a text writes as a date, and the number that it writes; null where it does not."""
    text = F.trim(text)
    dated = F.regexp_replace(text, r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3")
    seconds = epoch_seconds(F.when(dated.rlike(_TEXT_TIME), dated).try_cast("timestamp"), T.TimestampType())
    return seconds, F.when(text.isNull() | (text == ""), F.lit(0.0)).otherwise(plain_number(text))


def timeline(df: DataFrame, time: str, keys: Seq[str] = ("run",), *, tie: str = "row_pos") -> DataFrame:
    """Adds `seconds` since the first row of each run.

    Temporal columns count seconds; numeric ones are taken as milliseconds when they start above 1e11 or when
    the upper median of their positive steps exceeds 1000. A run whose texts are all dates counts seconds, one whose
    texts are all numbers is taken as numeric. Anything else, or a run with an unreadable time, counts rows.
    """
    dtype = dtype_of(df, time)
    kind = "text" if isinstance(dtype, T.StringType) else kind_of(dtype)
    if kind == "text":
        date, number = _text_times(F.col(time))
        rows = Ordered(df.withColumn("__date", date).withColumn("__number", finite(number)), keys, [tie]).totals(
            {"__dated": F.bool_and(F.col("__date").isNotNull())}).df
        rows = rows.withColumn("__t", F.when(F.col("__dated"), F.col("__date")).otherwise(F.col("__number"))).drop("__date", "__number")
    else:
        value = epoch_seconds(F.col(time), dtype) if kind != "other" else F.lit(None).cast("double")
        if kind == "numeric":
            value = F.coalesce(value, F.lit(0.0))
        rows = df.withColumn("__t", finite(value)).withColumn("__dated", F.lit(kind == "temporal"))
    o = Ordered(rows, keys, [tie]).row_number("__i").lag({"__p": "__t"})
    step = F.when(F.col("__t") > F.col("__p"), F.col("__t") - F.col("__p"))
    o = o.with_columns({"__step": step}).totals({
        "__first": F.max(F.when(F.col("__i") == 1, F.col("__t"))), "__bad": F.count_if(F.col("__t").isNull()),
        "__steps": F.count("__step"), "__short": F.count_if(F.col("__step") <= 1000)})
    # the element at floor(n / 2) of the sorted steps exceeds 1000 when at most floor(n / 2) steps do not
    wide = (F.col("__steps") > 0) & (F.col("__short") <= F.floor(F.col("__steps") / 2))
    scale = F.when(~F.col("__dated") & ((F.abs("__first") > 1e11) | wide), 1000.0).otherwise(1.0)
    seconds = F.when(F.col("__bad") > 0, (F.col("__i") - 1).cast("double")).otherwise(
        (F.col("__t") - F.col("__first")) / scale)
    return o.df.withColumn("seconds", seconds).drop(
        "__t", "__dated", "__i", "__p", "__step", "__first", "__bad", "__steps", "__short")


def _meters(lat1, lon1, lat2, lon2):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * COURSE_EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def course_axis(df: DataFrame, x: str, y: str, seconds: str = "seconds", speed: str | None = None, *,
                geographic: bool = True, keys: Seq[str] = ("run",), tie: str = "row_pos") -> DataFrame:
    """Adds estimated, filled_x, filled_y, distance, progress (0..1), usable and estimated_count to each row.

    A position is bad when missing, out of range, at (0, 0) while the run has real positions, or unchanged
    since the last good one while the speed is above 0.5. Gaps are filled between good positions in proportion
    to the driven distance (mean speed times time, or time alone); the ends hold.
    """
    px, py = finite(F.col(x)), finite(F.col(y))
    v = F.coalesce(F.col(speed).cast("double"), F.lit(0.0)) if speed else F.lit(None).cast("double")
    base = df.withColumn("__x", px).withColumn("__y", py).withColumn("__v", v).withColumn(
        "__t", F.col(seconds).cast("double"))
    both = F.col("__x").isNotNull() & F.col("__y").isNotNull()
    away = (F.abs("__x") > ORIGIN_EPSILON) | (F.abs("__y") > ORIGIN_EPSILON)
    o = Ordered(base, keys, [tie])
    if geographic:
        o = o.totals({"__real": F.bool_or(both & away)})
        inside = (F.abs("__y") <= 90) & (F.abs("__x") <= 180) & (away | ~F.col("__real"))
        ok = F.coalesce(both & inside, F.lit(False))
    else:
        ok = F.coalesce(both, F.lit(False))
    o = o.with_columns({"__ok": ok})
    if speed:
        spot = F.when(F.col("__ok"), F.struct("__x", "__y"))
        o = o.last_known({"__back": spot}, inclusive=False)
        frozen = (F.abs(F.col("__x") - F.col("__back.__x")) < FROZEN_COORD_EPSILON) & (
            F.abs(F.col("__y") - F.col("__back.__y")) < FROZEN_COORD_EPSILON) & (F.col("__v") > FROZEN_MIN_SPEED)
        o = o.with_columns({"__ok": F.col("__ok") & ~F.coalesce(frozen, F.lit(False))})
    o = o.lag({"__pt": "__t", "__pv": "__v"})
    dt = F.greatest(F.lit(MIN_TIME_STEP), F.coalesce(F.col("__t") - F.col("__pt"), F.lit(MIN_TIME_STEP)))
    pace = F.greatest(F.lit(0.0), (F.col("__pv") + F.col("__v")) / 2)
    weight = F.when(pace > 0, pace * dt).otherwise(dt) if speed else dt
    o = o.with_columns({"__w": F.when(F.col("__pt").isNull(), F.lit(0.0)).otherwise(weight)})
    o = o.running_sum({"__cum": F.col("__w")})
    anchor = F.when(F.col("__ok"), F.struct("__x", "__y", "__cum"))
    o = o.last_known({"__a": anchor}).next_known({"__b": anchor})
    width = F.col("__b.__cum") - F.col("__a.__cum")
    part = F.when(width > 0, (F.col("__cum") - F.col("__a.__cum")) / width).otherwise(F.lit(0.0))

    def fill(axis: str):
        a, b = F.col(f"__a.{axis}"), F.col(f"__b.{axis}")
        return (F.when(F.col("__ok"), F.col(axis)).when(F.col("__a").isNull(), b).when(F.col("__b").isNull(), a)
                .otherwise(a + (b - a) * part))

    o = o.with_columns({"filled_x": F.coalesce(fill("__x"), F.col("__x")),
                        "filled_y": F.coalesce(fill("__y"), F.col("__y"))})
    o = o.lag({"__fx": "filled_x", "__fy": "filled_y"})
    fx, fy = F.col("filled_x"), F.col("filled_y")
    piece = _meters(F.col("__fy"), F.col("__fx"), fy, fx) if geographic else F.hypot(
        fx - F.col("__fx"), fy - F.col("__fy"))
    o = o.with_columns({"__d": F.coalesce(finite(piece), F.lit(0.0))})
    o = o.running_sum({"distance": F.col("__d")}).row_number("__i")
    o = o.totals({"__total": F.max("distance"), "__n": F.count(F.lit(1)), "__good": F.count_if(F.col("__ok"))})
    by_index = F.when(F.col("__n") > 1, (F.col("__i") - 1) / (F.col("__n") - 1)).otherwise(F.lit(0.0))
    moving = (F.col("__total") > 0) & (F.col("__good") > 0)
    added = ["estimated", "filled_x", "filled_y", "distance", "progress", "usable", "estimated_count"]
    out = o.df.withColumn("progress", F.when(moving, F.col("distance") / F.col("__total")).otherwise(by_index))
    out = out.withColumn("estimated", ~F.col("__ok")).withColumn("usable", F.col("__good") >= 2).withColumn(
        "estimated_count", F.col("__n") - F.col("__good"))
    return out.select(*[c for c in df.columns if c not in added], *added)


class _Held:
    """Rows of one run that are still needed, as one growing array without those at its front that are done with."""

    def __init__(self) -> None:
        self.data, self.first, self.end, self.dropped = np.empty((1_024, 3)), 0, 0, 0

    def add(self, rows: np.ndarray) -> None:
        held = self.end - self.first
        if self.end + len(rows) > len(self.data):
            room = np.empty((max(len(self.data), 2 * (held + len(rows))), 3))
            room[:held] = self.data[self.first:self.end]
            self.data, self.first, self.end = room, 0, held
        self.data[self.end:self.end + len(rows)] = rows
        self.end += len(rows)

    def drop_to(self, place: int) -> None:
        """Forget the rows before the place, counted from the start of the run."""
        self.first += place - self.dropped
        self.dropped = place

    def rows(self, start: int, stop: int) -> np.ndarray:
        return self.data[self.first + start - self.dropped:self.first + stop - self.dropped]

    @property
    def seen(self) -> int:
        return self.dropped + self.end - self.first


class _Matching:
    """One pair in the making: target rows wait until the part of the course that their match can lie in has been read."""

    def __init__(self, start: int, course: int, run: int, geographic: bool):
        self.course, self.waiting = _Held(), _Held()
        self.at, self.length, self.geographic, self.done = start, course, geographic, 0
        self.ahead = max(COURSE_SEARCH_MIN, math.ceil(max(1.0, course / max(1, run)) * COURSE_SEARCH_FACTOR))

    def advance(self) -> list[float]:
        out = []
        while self.done < self.waiting.seen:
            first = self.done == 0  # its place was sought on the whole course
            stop = self.at + 1 if first else min(self.length, self.at + self.ahead + 1)
            if self.course.seen < stop:
                break
            x, y, _ = self.waiting.rows(self.done, self.done + 1)[0]
            if not first:
                near = self.course.rows(self.at, stop)
                gap = ((near[:, 0] - x) * (math.cos(math.radians(y)) if self.geographic else 1.0)) ** 2 + (near[:, 1] - y) ** 2
                gap[np.isnan(gap)] = np.inf
                self.at += int(gap.argmin())
            out.append(float(self.course.rows(self.at, self.at + 1)[0, 2]))
            self.done += 1
        self.course.drop_to(min(self.at, self.course.seen))
        self.waiting.drop_to(self.done)
        return out


def _match_rows(geographic: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pair, matching, rows_left = None, None, None, []
        for batch in batches:
            keys = batch["key"].to_numpy(object)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for begin, end in zip(cuts, cuts[1:]):
                part = batch.iloc[begin:end]
                if keys[begin] != current:
                    current, head, rows_left = keys[begin], part.iloc[0], []
                    matching = _Matching(int(head["start"]), int(head["course"]), int(head["run"]), geographic)
                on_course = part["side"].to_numpy() == 0
                points = part[["x", "y", "progress"]].to_numpy(dtype=float, na_value=np.nan)
                matching.course.add(points[on_course])
                matching.waiting.add(points[~on_course])
                rows_left.append(part.loc[~on_course, ["pair", "row_pos"]])
                places = matching.advance()
                if places:
                    waiting = pd.concat(rows_left)
                    yield waiting.iloc[:len(places)].assign(progress=places)
                    rows_left = [waiting.iloc[len(places):]]
    return run


def match_course(reference: DataFrame, target: DataFrame, *, geographic: bool = True) -> DataFrame:
    """(pair, row_pos, progress): the target's place on the reference course, never moving backwards.

    Inputs: runs (pair, row_pos, filled_x, filled_y, progress) of any length. Without a reference a row keeps its own progress.

    A match depends on the one before it, so a pair is one task. It reads both runs side by side, in order of their share of the rows,
    and holds what lies between the place of the match and the end of its search, or the rows of the run that is behind. The place of
    the first target row, which is sought on the whole course, comes from an aggregation beforehand.
    """
    columns = ["pair", "row_pos", F.col("filled_x").cast("double").alias("x"), F.col("filled_y").cast("double").alias("y"),
               F.col("progress").cast("double").alias("progress")]
    course, run = (materialize(Ordered(side.select(*columns), ["pair"], ["row_pos"]).row_number("i", "n").df) for side in (reference, target))
    first = run.filter("i = 1").select("pair", F.col("n").alias("run"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    scale = F.cos(F.radians("__y")) if geographic else F.lit(1.0)
    gap = F.pow((F.col("x") - F.col("__x")) * scale, F.lit(2)) + F.pow(F.col("y") - F.col("__y"), F.lit(2))
    gap = F.when(gap.isNull() | F.isnan(gap), F.lit(float("inf"))).otherwise(gap)
    starts = join_on(course, first, ["pair"], "inner", null_keys=["pair"]).groupBy("pair").agg(
        F.min(F.struct(gap.alias("gap"), (F.col("i") - 1).alias("i")))["i"].alias("start"), F.first("n").alias("course"), F.first("run").alias("run"))
    starts = materialize(starts)  # one row per pair
    share = (F.col("i") / F.col("n")).alias("share")
    sides = course.select("pair", F.lit(0).alias("side"), share, "i", "row_pos", "x", "y", "progress").unionByName(
        run.select("pair", F.lit(1).alias("side"), share, "i", "row_pos", "x", "y", "progress"))
    key = F.to_json(F.struct("pair")).alias("key")
    both = join_on(sides, starts, ["pair"], "inner", null_keys=["pair"]).select("*", key)
    dealt = both.repartition("key").sortWithinPartitions("key", "share", "side", "i").select(
        "key", "pair", "side", "row_pos", "x", "y", "progress", "start", "course", "run")
    schema = f"pair {dtype_of(target, 'pair').simpleString()}, row_pos long, progress double"
    matched = dealt.mapInPandas(_match_rows(geographic), schema)
    led = starts.select("pair", F.lit(True).alias("__led"))
    alone = join_on(run, led, ["pair"], "left", null_keys=["pair"]).filter(F.col("__led").isNull())
    return matched.unionByName(alone.select("pair", F.col("row_pos").cast("long").alias("row_pos"), "progress"))
