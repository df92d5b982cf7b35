"""One method per request of the dashboard API, over a store of recordings. Results are DataFrames.

The methods pick the recordings and the columns to read (so that only their folders and columns are scanned)
and call the operators. Requests about one recording give its rows; requests about several give all of them in
one job.
"""

from __future__ import annotations

import json
from collections.abc import Sequence as Seq
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed_values import DEFAULT_BAND
from .functions.scalars import epoch_seconds
from .limits import PREVIEW_MAX, require
from .operators import (
    bins,
    charts,
    cohorts,
    compare,
    course,
    models,
    overlay,
    pairing,
    profile,
    regression,
    routes,
    sampling,
    schema,
    sequences,
    spectrum,
    stat_tests,
    tracks,
)
from .sources import RecordingStore


def _columns(*names: str | None, filters: list[dict] | None = None) -> list[str]:
    return list(dict.fromkeys([n for n in names if n] + [f["column"] for f in filters or []]))


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.store = RecordingStore(spark, root)

    def _load(self, ids: Seq[str] | DataFrame, *names: str | None, filters: list[dict] | None = None) -> DataFrame:
        """Rows of the recordings with the asked columns, each of which every recording must have."""
        wanted = _columns(*names, filters=filters)
        self._require_in_all(ids, wanted)
        return self.store.load(ids, wanted)

    def _require_in_all(self, ids: Seq[str] | DataFrame, names: Seq[str]) -> None:
        current = self.store.catalog()
        current = current.filter(F.col("dataset_id").isin(list(ids))) if isinstance(ids, (list, tuple)) else \
            current.join(ids.select("dataset_id").distinct(), "dataset_id", "left_semi")
        if isinstance(ids, (list, tuple)):
            require(current.count() == len(set(ids)), "no such dataset among the ids")
        for row in current.select("schema_json").distinct().collect():  # one row per distinct schema
            fields = {f["name"] for f in json.loads(row["schema_json"])["fields"]}
            lost = [n for n in names if n not in fields]
            require(not lost, f"columns missing in some recording: {', '.join(lost)}")

    # -- one recording ---------------------------------------------------

    def schema(self, dataset_id: str) -> DataFrame:
        return schema.describe(self.store.dataset(dataset_id))

    def preview(self, dataset_id: str, limit: int = 100) -> DataFrame:
        # positions of a stored recording are 0, 1, ..., so the scan can skip all later row groups
        first = self.store.dataset(dataset_id).filter(F.col("row_pos") < min(int(limit), PREVIEW_MAX))
        return sampling.preview(first, limit).drop("dataset_id", "row_pos")

    def summary(self, dataset_id: str, exact: bool = False) -> DataFrame:
        return profile.column_profile(self.store.dataset(dataset_id), exact=exact)

    def timeseries(self, dataset_id: str, x: str, ys: Seq[str], filters=None, max_points=None) -> DataFrame:
        return sampling.timeseries(self._load([dataset_id], x, *ys, filters=filters), x, ys, filters, max_points)

    def histogram(self, dataset_id: str, column: str, bins_: int = 40, filters=None) -> DataFrame:
        df = self._load([dataset_id], column, filters=filters)
        if schema.kinds(df)[column] != "numeric":
            return bins.category_histogram(df, column, filters)
        return bins.histogram(df, column, bins_, filters)

    def correlation(self, dataset_id: str, columns=None, filters=None) -> DataFrame:
        return profile.correlation(self.store.dataset(dataset_id), columns, filters)

    def scatter(self, dataset_id: str, x: str, y: str, color=None, filters=None, max_points=None) -> DataFrame:
        return sampling.scatter(self._load([dataset_id], x, y, color, filters=filters), x, y, color, filters, max_points)

    def chart(self, dataset_id: str, kind: str, x: str, y: str | None = None, color: str | None = None,
              agg: str = "avg", bins_: int = 40, filters=None, max_points=None) -> DataFrame:
        df = self._load([dataset_id], x, y, color, filters=filters)
        if kind in ("scatter", "line"):
            return charts.points(df, kind, x, y, color, filters, max_points)
        makers = {"bar": lambda: charts.bar(df, x, y, color, agg, filters),
                  "box": lambda: charts.box(df, x, y, color, filters),
                  "histogram": lambda: charts.histogram_by_color(df, x, color, bins_, filters),
                  "heatmap": lambda: charts.heatmap(df, x, y, bins_, filters)}
        require(kind in makers, f"unknown chart kind: {kind}")
        return makers[kind]()

    def chart_stats(self, dataset_id: str, x: str, y: str | None = None, filters=None) -> DataFrame:
        df = self._load([dataset_id], x, y, filters=filters)
        kinds = schema.kinds(df)
        column = next((c for c in (y, x) if c and kinds[c] == "numeric"), None)
        require(column is not None, "no numeric column")
        return profile.stats_chip(df, column, filters)

    def cluster(self, dataset_id: str, features: Seq[str], k: int = 4, column_name: str = "cluster") -> DataFrame:
        """Labels the recording's rows, stores them as a column and gives the cluster profile."""
        labelled = models.cluster_rows(self.store.dataset(dataset_id), features, k, column_name)
        self.store.write_back(labelled, dataset_id)
        return models.cluster_profile(self.store.dataset(dataset_id), features, column_name.strip() or "cluster", k)

    # -- several recordings ----------------------------------------------

    def chart_groups(self, groups: dict[str, Seq[str]], kind: str, x: str, y: str | None = None, agg: str = "avg",
                     bins_: int = 40, filters=None, max_points=None) -> DataFrame:
        members = charts.group_members(groups, self.spark)
        ids = list(dict.fromkeys(i for g in groups.values() for i in g))
        df = self._load(ids, x, y, filters=filters)
        makers = {"bar": lambda: charts.group_bar(df, members, x, y, agg, filters),
                  "box": lambda: charts.group_box(df, members, x, y, filters),
                  "histogram": lambda: charts.group_histogram(df, members, x, bins_, filters),
                  "heatmap": lambda: charts.group_heatmap(df, members, x, y, bins_, filters),
                  "scatter": lambda: charts.group_points(df, members, "scatter", x, y, filters, max_points),
                  "line": lambda: charts.group_points(df, members, "line", x, y, filters, max_points)}
        require(kind in makers, f"unknown chart kind: {kind}")
        return makers[kind]()

    def _two(self, ids: Seq[str]) -> list[str]:
        require(len(ids) >= 2, "choose at least two recordings")
        return list(ids)

    def compare_histogram(self, ids, column, bins_=40, filters=None, as_category=False) -> DataFrame:
        df = self._load(self._two(ids), column, filters=filters)
        return compare.compare_histogram(df, column, bins_, filters, as_category=as_category)

    def compare_group_stats(self, ids, column, group_by, filters=None) -> DataFrame:
        return compare.compare_group_stats(self._load(self._two(ids), column, group_by, filters=filters), column, group_by, filters)

    def compare_summary(self, ids, column, filters=None) -> DataFrame:
        return compare.compare_summary(self._load(self._two(ids), column, filters=filters), column, filters)

    def compare_curve(self, ids, x, y, bins_=40, filters=None) -> DataFrame:
        return compare.compare_curve(self._load(self._two(ids), x, y, filters=filters), x, y, bins_, filters)

    def compare_cdf(self, ids, column, filters=None) -> DataFrame:
        return compare.compare_cdf(self._load(self._two(ids), column, filters=filters), column, filters)

    def compare_diff(self, ids, baseline=None, filters=None) -> DataFrame:
        """Scan of the numeric columns that all the recordings share."""
        ids = self._two(ids)
        baseline = baseline or ids[0]
        require(baseline in ids, "the baseline is not among the recordings")
        common = self.common_columns(ids, numeric_only=True)
        return compare.compare_diff(self._load(ids, *common, filters=filters), baseline, filters, columns=common)

    def common_columns(self, ids: Seq[str] | DataFrame, numeric_only: bool = False) -> list[str]:
        """Columns of the same kind in all recordings, compared once per distinct schema."""
        current = self.store.catalog()
        current = current.filter(F.col("dataset_id").isin(list(ids))) if isinstance(ids, (list, tuple)) else \
            current.join(ids.select("dataset_id").distinct(), "dataset_id", "left_semi")
        one_each = [r["d"] for r in current.groupBy("fingerprint").agg(F.min("dataset_id").alias("d")).collect()]
        return schema.common_columns([self.store.load([d]) for d in one_each], numeric_only)

    # -- cohorts ---------------------------------------------------------

    def cohort_members(self, specs: list[dict]) -> DataFrame:
        """Membership of checked, non-empty cohorts."""
        catalog = self.store.catalog()
        cohorts.resolve(catalog, specs)
        return cohorts.membership(catalog, specs)

    def resolve_cohorts(self, specs: list[dict]) -> DataFrame:
        return cohorts.resolve(self.store.catalog(), specs)

    def cohort_overlaps(self, specs: list[dict]) -> DataFrame:
        return cohorts.overlaps(self.cohort_members(specs))

    def _cohort(self, specs, *names, filters=None) -> tuple[DataFrame, DataFrame]:
        members = self.cohort_members(specs)
        return self._load(cohorts.dataset_ids(members), *names, filters=filters), members

    def cohort_histogram(self, specs, column, bins_=40, filters=None, as_category=False) -> DataFrame:
        df, members = self._cohort(specs, column, filters=filters)
        return cohorts.cohort_histogram(df, members, column, bins_, filters, as_category=as_category)

    def cohort_histogram2d(self, specs, x, y, bins_x=40, bins_y=40, filters=None) -> DataFrame:
        df, members = self._cohort(specs, x, y, filters=filters)
        return cohorts.cohort_histogram2d(df, members, x, y, bins_x, bins_y, filters)

    def cohort_values(self, specs, columns: Seq[str], metric="avg", filters=None) -> DataFrame:
        df, members = self._cohort(specs, *columns, filters=filters)
        return cohorts.representative_values(df, members, columns, metric, filters)

    def cohort_summary(self, specs, columns: Seq[str], metric="avg", filters=None) -> DataFrame:
        return cohorts.describe_values(self.cohort_values(specs, columns, metric, filters), ["signal", "cohort"])

    def cohort_comparisons(self, specs, columns: Seq[str], metric="avg", filters=None) -> DataFrame:
        return stat_tests.compare_cohorts(self.cohort_values(specs, columns, metric, filters))

    def cohort_regression(self, specs, x, y, filters=None) -> DataFrame:
        df, members = self._cohort(specs, x, y, filters=filters)
        return regression.cohort_regression(df, members, x, y, filters)

    def cohort_pca(self, specs, columns: Seq[str], filters=None) -> tuple[DataFrame, DataFrame]:
        df, members = self._cohort(specs, *columns, filters=filters)
        return models.cohort_pca(df, members, columns, filters)

    def cohort_correlation(self, specs, columns: Seq[str] | None = None, filters=None) -> DataFrame:
        members = self.cohort_members(specs)
        common = self.common_columns(cohorts.dataset_ids(members), numeric_only=True)
        chosen = [c for c in (columns or common) if c in common]
        df = self._load(cohorts.dataset_ids(members), *chosen, filters=filters)
        return regression.cohort_correlation(df, members, chosen, filters)

    def cohort_spectrum(self, specs, signal, order_by, filters=None, band=DEFAULT_BAND) -> DataFrame:
        df, members = self._cohort(specs, signal, order_by, filters=filters)
        return spectrum.cohort_spectrum(df, members, signal, order_by, filters, band)

    def cohort_events(self, specs, state, value, order_by, time_column=None, secondary=None, filters=None) -> DataFrame:
        df, members = self._cohort(specs, state, order_by, time_column, secondary, filters=filters)
        return sequences.event_summary(df, members, state, value, order_by, time_column, secondary, filters)

    def cohort_transitions(self, specs, state, order_by, filters=None, denominator=None, scale=1.0) -> DataFrame:
        df, members = self._cohort(specs, state, order_by, denominator, filters=filters)
        return sequences.transition_rates(df, members, state, order_by, filters, denominator, scale)

    # -- positions -------------------------------------------------------

    def gps_datasets(self) -> DataFrame:
        return pairing.list_gps(self.store.list_datasets())

    def gps_pairs(self) -> DataFrame:
        return pairing.gps_pairs(self.store.catalog())

    def _extents(self) -> DataFrame:
        """Extents of all position logs; logs with the same coordinate columns are one job."""
        gps = pairing.list_gps(self.store.catalog())
        kinds = [(r["coord_kind"], list(r["coord_cols"])) for r in gps.select("coord_kind", "coord_cols").distinct().collect()]
        parts = []
        for kind, coords in kinds:
            ids = gps.filter((F.col("coord_kind") == kind) & (F.col("coord_cols") == F.array(*[F.lit(c) for c in coords])))
            y, x = (coords[0], coords[1]) if kind == "latlon" else (coords[1], coords[0])
            parts.append(routes.route_extents(self.store.load(ids.select("dataset_id"), coords), x, y, geographic=kind == "latlon"))
        require(bool(parts), "no position logs")
        return reduce(DataFrame.unionByName, parts)

    def similar_runs(self, signal_id: str, limit: int = 10) -> DataFrame:
        self.store.get(signal_id)
        return routes.similar_runs(self.gps_pairs(), self._extents(), self.store.catalog(), signal_id, limit)

    def map_track(self, dataset_id: str, signals: Seq[str] = (), *, gps_id: str | None = None, **options) -> tuple[DataFrame, dict]:
        """Sampled rows of one recording with positions, from the given or the paired position log."""
        own = self.store.get(dataset_id)
        if gps_id is None:
            found = self.gps_pairs().filter(F.col("signal_id") == dataset_id).first()
            require(found is not None, "no position log belongs to this recording; choose one")
            gps_id = found["gps_id"]
        other = self.store.get(gps_id)
        side = [self.store.dataset(i).withColumn("pair", F.lit(dataset_id)).drop("dataset_id") for i in (dataset_id, gps_id)]
        return tracks.map_track(*side, signals, same_log=gps_id == dataset_id, signal_name=own["original_filename"],
                                gps_name=other["original_filename"], **options)

    def _course(self, dataset_id: str, signals: Seq[str] = (), **options) -> tuple[DataFrame, bool]:
        """The course, and whether its positions are geographic."""
        speed = schema.speed_column(schema.name_kinds(self.store.dataset(dataset_id)))
        wanted = list(dict.fromkeys([*signals, *([speed] if speed else [])]))
        rows, roles = self.map_track(dataset_id, wanted, **options)
        timed = course.timeline(rows, roles["x_axis"] or "row_pos", ["pair"])
        geographic = roles["mode"] == "geographic"
        return course.course_axis(timed, "track_x", "track_y", speed=speed, geographic=geographic, keys=["pair"]), geographic

    def course(self, dataset_id: str, signals: Seq[str] = (), **options) -> DataFrame:
        """The track with elapsed seconds, filled gaps and progress along the course."""
        return self._course(dataset_id, signals, **options)[0]

    def match_courses(self, reference_id: str, target_id: str, **options) -> DataFrame:
        """Progress of the target run on the course of the reference run."""
        label = F.lit(f"{reference_id}/{target_id}")
        (a, geographic), (b, other) = (self._course(i, **options) for i in (reference_id, target_id))
        require(geographic == other, "one run has geographic positions, the other planar ones")
        return course.match_course(a.withColumn("pair", label), b.withColumn("pair", label), geographic=geographic)

    def overlay(self, id_a: str, id_b: str | None, x: str, ys: Seq[str], filters=None, *, offset: float = 0.0,
                by_signal: bool = False, max_points: int | None = None) -> DataFrame:
        b = self.store.dataset(id_b) if id_b else None
        return overlay.overlay_runs(self.store.dataset(id_a), b, x, ys, filters, self.store.alias_pairs(), offset=offset,
                                    by_signal=by_signal, max_points=max_points)

    def best_offset(self, id_a: str, id_b: str, x: str, signals: Seq[str]) -> DataFrame:
        """Offset of run B found from the most telling signal both runs have."""
        both = self.common_columns([id_a, id_b])
        shared = [s for s in signals if s in both]
        require(bool(shared), "the runs share none of the signals")
        chosen = overlay.offset_signal(shared)
        loaded = [self._load([i], x, chosen) for i in (id_a, id_b)]
        side = [rows.select(F.lit(f"{id_a}/{id_b}").alias("pair"), "row_pos", epoch_seconds(F.col(x), rows.schema[x].dataType).alias("t"),
                            F.col(chosen).cast("double").alias("y")) for rows in loaded]
        return overlay.best_offset(*side)
