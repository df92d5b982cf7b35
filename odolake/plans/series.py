"""Scans, filters, sampling, catalog and column profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bins, catalog, overlay, profile, sampling
from ..operators.filters import apply_filters
from ..operators.ordered import Ordered
from ..operators.schema import use_label_set
from ..sources.readers import read_parquet, stitch
from . import tables
from .registry import query, rounded


@query("timeseries_stride", """
f AS (SELECT dataset_id, ts, value, row_pos,
             row_number() OVER (PARTITION BY dataset_id ORDER BY ts NULLS LAST, row_pos) AS rn,
             count(*) OVER (PARTITION BY dataset_id) AS total_rows
      FROM ev WHERE event_type = 'click'),
s AS (SELECT *, greatest(1, CAST(ceil(total_rows / 5.0) AS BIGINT)) AS stride FROM f)
SELECT dataset_id, ts, value, row_pos, rn, total_rows, stride FROM s WHERE (rn - 1) % stride = 0""")
def timeseries_stride(spark, sf):
    """Clicks of every user over time, thinned to about 5 points per user."""
    only = [{"column": "event_type", "op": "eq", "value": "click"}]
    return sampling.timeseries(tables.events(spark, sf), "ts", ["value"], only, 5)


@query("scatter_stride", """
f AS (SELECT dataset_id, k, value, event_type, row_pos,
             row_number() OVER (PARTITION BY dataset_id ORDER BY row_pos) AS rn,
             count(*) OVER (PARTITION BY dataset_id) AS total_rows FROM ev),
s AS (SELECT *, greatest(1, CAST(ceil(total_rows / 20.0) AS BIGINT)) AS stride FROM f)
SELECT dataset_id, k, value, event_type, row_pos, rn, total_rows, stride FROM s WHERE (rn - 1) % stride = 0""")
def scatter_stride(spark, sf):
    return sampling.scatter(tables.events(spark, sf), "k", "value", "event_type", max_points=20)


@query("group_sample", """
f AS (SELECT event_type, row_pos, value, row_number() OVER (PARTITION BY event_type ORDER BY row_pos) AS rn,
             count(*) OVER (PARTITION BY event_type) AS total_rows FROM ev),
s AS (SELECT *, greatest(1, total_rows // 300) AS stride FROM f)
SELECT event_type, row_pos, value, rn, total_rows, stride FROM s WHERE (rn - 1) % stride = 0""")
def group_sample(spark, sf):
    rows = tables.events(spark, sf).select("event_type", "row_pos", "value")
    return sampling.group_sample(rows, ["event_type"], ["row_pos"], 300)


@query("row_numbers_in_chunks", """
SELECT dataset_id, row_pos, row_number() OVER (PARTITION BY dataset_id ORDER BY o_totalprice NULLS LAST, row_pos) AS rn,
       count(*) OVER (PARTITION BY dataset_id) AS total_rows FROM od""")
def row_numbers_in_chunks(spark, sf):
    """Row numbers of large recordings without one task per recording: the range-chunked way, always."""
    rows = tables.orders(spark, sf).select("dataset_id", "row_pos", "o_totalprice")
    numbered = Ordered(rows, ["dataset_id"], ["o_totalprice", "row_pos"], split=True).row_number("rn", "total_rows")
    return numbered.df.select("dataset_id", "row_pos", "rn", "total_rows")


@query("preview_rows", "SELECT dataset_id, row_pos, value, event_type FROM ev ORDER BY row_pos LIMIT 100")
def preview_rows(spark, sf):
    return sampling.preview(tables.events(spark, sf).select("dataset_id", "row_pos", "value", "event_type"))


@query("parquet_row_positions", """
SELECT event_id AS row_pos, event_id, user_id, value FROM events""")
def parquet_row_positions(spark, sf):
    """The file's row positions equal the event ids."""
    return read_parquet(spark, f"{sf}/events.parquet").select("row_pos", "event_id", "user_id", "value")


@query("stitch_by_name", """
p AS (SELECT 0 AS part, row_pos AS pos, ts, value, CAST(NULL AS BIGINT) AS k FROM ev WHERE ts >= TIMESTAMP '2024-01-16'
      UNION ALL SELECT 1, row_pos, ts, value, k FROM ev WHERE ts < TIMESTAMP '2024-01-16')
SELECT 'stitched' AS dataset_id, row_number() OVER (ORDER BY part, pos) - 1 AS row_pos, ts, value, k FROM p""")
def stitch_by_name(spark, sf):
    """Two parts joined in the given order; the first lacks column k."""
    rows = tables.events(spark, sf).select("row_pos", "ts", "value", "k")
    middle = F.lit("2024-01-16").cast("timestamp_ntz")
    out = stitch([rows.filter(F.col("ts") >= middle).drop("k"), rows.filter(F.col("ts") < middle)])
    return out.select("dataset_id", "row_pos", "ts", "value", "k")


@query("filter_numbers_and_times", """
SELECT row_pos, dataset_id, value, k FROM ev
WHERE value >= 5.0 AND value < 120.0 AND k <> 7.0 AND CAST(ts AS VARCHAR) >= '2024-01-05' AND CAST(ts AS VARCHAR) < '2024-01-25'""")
def filter_numbers_and_times(spark, sf):
    return apply_filters(tables.events(spark, sf), [
        {"column": "value", "op": "ge", "value": "5"}, {"column": "value", "op": "lt", "value": 120},
        {"column": "k", "op": "ne", "value": 7}, {"column": "ts", "op": "ge", "value": "2024-01-05"},
        {"column": "ts", "op": "lt", "value": "2024-01-25"}]).select("row_pos", "dataset_id", "value", "k")


@query("filter_times_by_prefix", """
SELECT o_orderkey, o_orderdate FROM orders
WHERE CAST(o_orderdate AS VARCHAR) >= '1993-11' AND CAST(o_orderdate AS VARCHAR) <= '1995-03-1' AND CAST(o_orderdate AS VARCHAR) <> '1994-02-03 00:00:00'""")
def filter_times_by_prefix(spark, sf):
    """Text comparisons of times with a month and the beginning of a day; the scan gets the range that they imply."""
    return apply_filters(tables.table(spark, sf, "orders"), [
        {"column": "o_orderdate", "op": "ge", "value": "1993-11"}, {"column": "o_orderdate", "op": "le", "value": "1995-03-1"},
        {"column": "o_orderdate", "op": "ne", "value": "1994-02-03 00:00:00"}]).select("o_orderkey", "o_orderdate")


@query("filter_text", """
SELECT p_partkey, p_name, p_type FROM part
WHERE p_name LIKE '%r_d%' AND p_type > 'ECONOMY' AND p_brand IS NOT NULL AND CAST(p_size AS VARCHAR) LIKE '%1%'""")
def filter_text(spark, sf):
    """Text comparison, wildcards inside `contains`, `contains` on a number, and null tests."""
    return apply_filters(tables.table(spark, sf, "part"), [
        {"column": "p_name", "op": "contains", "value": "r_d"}, {"column": "p_type", "op": "gt", "value": "ECONOMY"},
        {"column": "p_brand", "op": "notnull"}, {"column": "p_size", "op": "contains", "value": "1"},
    ]).select("p_partkey", "p_name", "p_type")


@query("label_set_projection", "SELECT dataset_id, row_pos, value, k FROM ev")
def label_set_projection(spark, sf):
    return use_label_set(tables.events(spark, sf), ["value", "missing_signal", "k"])[0]


@query("two_run_overlay", """
a AS (SELECT 'a' AS run, dataset_id, o_totalprice AS x, row_pos AS key, row_pos FROM od WHERE o_totalprice > 1000.0),
b AS (SELECT 'b' AS run, dataset_id, value AS x, k AS key, row_pos FROM ev),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY x, row_pos) AS rn,
             count(*) OVER (PARTITION BY dataset_id) AS total_rows FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
s AS (SELECT *, greatest(1, CAST(ceil(total_rows / 50.0) AS BIGINT)) AS stride FROM n)
SELECT run, dataset_id, CASE WHEN run = 'b' THEN x + 2.5 ELSE x END AS o_totalprice, key AS signal, rn, total_rows, stride
FROM s WHERE (rn - 1) % stride = 0""")
def two_run_overlay(spark, sf):
    """Orders beside events under the orders' names: columns found by alias, an offset, and a filter the second run
    cannot serve."""
    a = tables.orders(spark, sf).withColumn("signal", F.col("row_pos"))
    b = tables.events(spark, sf)
    aliases = [("price", "o_totalprice"), ("price", "value"), ("signal", "signal"), ("signal", "k")]
    only = [{"column": "o_custkey", "op": "ge", "value": 0}, {"column": "signal", "op": "notnull"}]
    a = apply_filters(a, [{"column": "o_totalprice", "op": "gt", "value": 1000}])
    return overlay.overlay_runs(a, b, "o_totalprice", ["signal"], only, aliases, offset=2.5, max_points=50)


@query("catalog_listing", "SELECT dataset_id, row_count, created_at, array_to_string(tags, ',') AS tags FROM cat")
def catalog_listing(spark, sf):
    out = catalog.newest_first(tables.catalog(spark, sf))
    return out.select("dataset_id", "row_count", "created_at", F.array_join("tags", ",").alias("tags"))


@query("catalog_tag_edits", """
t AS (SELECT dataset_id, list_filter(tags, lambda t: t <> 'g1') AS kept FROM cat)
SELECT dataset_id, array_to_string(list_concat(kept, list_filter(['odd', 'even'], lambda t: NOT list_contains(kept, t))), ',')
  AS tags FROM t""")
def catalog_tag_edits(spark, sf):
    out = catalog.edit_tags(tables.catalog(spark, sf), add=["odd", "even", " odd "], remove=["g1"])
    return out.select("dataset_id", F.array_join("tags", ",").alias("tags"))


@query("catalog_set_tags", """
SELECT dataset_id, CASE WHEN user_id % 2 = 0 THEN 'even,u' || CAST(user_id AS VARCHAR)
                        ELSE 'u' || CAST(user_id AS VARCHAR) END AS tags FROM cat""")
def catalog_set_tags(spark, sf):
    """Tags typed with spaces, empty entries and repeats."""
    raw = tables.catalog(spark, sf)
    even = F.when(F.col("user_id") % 2 == 0, F.lit(" even")).otherwise(F.lit("  "))
    typed = F.array(F.lit(""), even, F.concat(F.col("dataset_id"), F.lit(" ")), F.col("dataset_id"))
    return catalog.set_tags(raw, typed).select("dataset_id", F.array_join("tags", ",").alias("tags"))


@query("catalog_all_tags", "SELECT DISTINCT unnest(tags) AS tag FROM cat")
def catalog_all_tags(spark, sf):
    return catalog.distinct_tags(tables.catalog(spark, sf))


@query("catalog_by_any_tag", """
SELECT dataset_id, row_count FROM cat WHERE list_contains(tags, 'g2') OR list_contains(tags, 'even')""")
def catalog_by_any_tag(spark, sf):
    return catalog.filter_by_tags(tables.catalog(spark, sf), ["g2", "even"]).select("dataset_id", "row_count")


@query("catalog_without_deleted", "SELECT dataset_id, row_count FROM cat WHERE dataset_id NOT IN ('u1', 'u7')")
def catalog_without_deleted(spark, sf):
    return catalog.without(tables.catalog(spark, sf), ["u1", "u7"]).select("dataset_id", "row_count")


def _profile_sql(columns):
    one = """SELECT '{c}' AS column_name, min({c})::DOUBLE AS "min", max({c})::DOUBLE AS "max", round(avg({c}), 6) AS "avg",
      round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
      round(quantile_cont({c}, 0.75), 6) AS q75, count(*) AS "count",
      round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage FROM lineitem"""
    return " UNION ALL ".join(one.format(c=c) for c in columns)


@query("column_profile", f"SELECT * FROM ({_profile_sql(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'])})")
def column_profile(spark, sf):
    rows = tables.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    out = profile.column_profile(rows, exact=True)
    return rounded(out.select("column_name", F.col("min").cast("double").alias("min"),
                              F.col("max").cast("double").alias("max"), "avg", "std", "q25", "q50", "q75", "count",
                              "null_percentage"))


@query("column_profile_times", """
SELECT 'l_shipdate' AS column_name, 'timestamp_ntz' AS column_type, round(avg(s), 1) AS "avg", round(quantile_cont(s, 0.25), 3) AS q25,
  round(quantile_cont(s, 0.5), 3) AS q50, round(quantile_cont(s, 0.75), 3) AS q75, count(*) AS "count", CAST(min(l_shipdate) AS VARCHAR) AS "min",
  CAST(max(l_shipdate) AS VARCHAR) AS "max" FROM (SELECT l_shipdate, epoch_us(l_shipdate) / 1e6 AS s FROM lineitem)""")
def column_profile_times(spark, sf):
    """Mean and exact quartiles of a time column, in seconds since 1970."""
    out = profile.column_profile(tables.table(spark, sf, "lineitem").select("l_shipdate"), exact=True)
    return out.select("column_name", "column_type", F.round("avg", 1).alias("avg"), *[F.round(q, 3).alias(q) for q in ("q25", "q50", "q75")],
                      "count", "min", "max")


@query("column_profile_sketched")
def column_profile_sketched(spark, sf):
    """The default profile: sketched quartiles and distinct counts of every column in one scan."""
    return profile.column_profile(tables.events(spark, sf))


@query("stats_chip", """
SELECT dataset_id, count(l_quantity) AS "count", round(avg(l_quantity), 6) AS "avg", round(stddev_samp(l_quantity), 6) AS std,
  min(l_quantity) AS "min", max(l_quantity) AS "max", round(quantile_cont(l_quantity, 0.5), 6) AS median
FROM li WHERE l_discount >= 0.02 GROUP BY dataset_id""")
def stats_chip(spark, sf):
    only = [{"column": "l_discount", "op": "ge", "value": 0.02}]
    return rounded(profile.stats_chip(tables.lineitem(spark, sf), "l_quantity", only, keys=["dataset_id"]))


@query("correlation_matrix", """
p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r FROM lineitem
  UNION ALL SELECT 'l_quantity', 'l_discount', corr(l_quantity, l_discount) FROM lineitem
  UNION ALL SELECT 'l_extendedprice', 'l_discount', corr(l_extendedprice, l_discount) FROM lineitem)
SELECT a, b, round(r, 4) AS r FROM p UNION ALL SELECT b, a, round(r, 4) FROM p
UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS c)""")
def correlation_matrix(spark, sf):
    return profile.correlation(tables.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("name_scalars", """
n AS (SELECT event_id, CASE event_id % 4
    WHEN 0 THEN 'Bus_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.csv'
    WHEN 1 THEN strftime(ts, '%y%m%d_%H%M%S') || '_GPS.parquet'
    WHEN 2 THEN 'drive ' || CAST(event_id AS VARCHAR) || '-latlon.pq'
    ELSE 'Log' || strftime(ts, '%Y%m%d%H%M%S') || ' Track' END AS name, ts FROM events)
SELECT event_id, CASE event_id % 4
    WHEN 0 THEN 'bus_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') WHEN 1 THEN strftime(ts, '%y%m%d_%H%M%S')
    WHEN 2 THEN 'drive ' || CAST(event_id AS VARCHAR) ELSE 'log' || strftime(ts, '%Y%m%d%H%M%S') END AS base,
  CASE WHEN event_id % 4 = 2 THEN NULL ELSE date_trunc('second', ts) END AS started FROM n""")
def name_scalars(spark, sf):
    """Pairing key and start time read back from four styles of file names."""
    raw = tables.table(spark, sf, "events")
    style = F.col("event_id") % 4
    name = (F.when(style == 0, F.concat(F.lit("Bus_"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit(".csv")))
            .when(style == 1, F.concat(F.date_format("ts", "yyMMdd_HHmmss"), F.lit("_GPS.parquet")))
            .when(style == 2, F.concat(F.lit("drive "), F.col("event_id"), F.lit("-latlon.pq")))
            .otherwise(F.concat(F.lit("Log"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(" Track"))))
    named = raw.select("event_id", name.alias("name"))
    return named.select("event_id", scalars.base_name(F.col("name")).alias("base"),
                        scalars.recording_start(F.col("name")).alias("started"))


@query("folded_colors", """
c AS (SELECT dataset_id, CAST(k AS VARCHAR) AS label, count(*) AS n FROM ev GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n DESC, label) AS place FROM c)
SELECT ev.dataset_id, ev.row_pos, CASE WHEN r.place <= 8 THEN r.label ELSE 'other' END AS series
FROM ev JOIN r ON ev.dataset_id = r.dataset_id AND CAST(ev.k AS VARCHAR) = r.label""")
def folded_colors(spark, sf):
    rows = tables.events(spark, sf).select("dataset_id", "row_pos", "k")
    return sampling.fold_colors(rows, "k", ["dataset_id"]).select("dataset_id", "row_pos", "series")


@query("histogram_numeric", """
r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 40 AS width FROM ev WHERE k >= 10.0),
b AS (SELECT least(CAST(floor((value - lo) / width) AS INT), 39) AS bin, count(*) AS n FROM ev, r WHERE k >= 10.0 GROUP BY 1)
SELECT CAST(g AS INT) AS bin, round(lo + width * g, 6) AS lower, round(lo + width * (g + 1), 6) AS upper,
       coalesce(n, 0) AS "count" FROM r, range(40) t(g) LEFT JOIN b ON b.bin = g""")
def histogram_numeric(spark, sf):
    only = [{"column": "k", "op": "ge", "value": 10}]
    return rounded(bins.histogram(tables.events(spark, sf), "value", 40, only))


@query("histogram_per_recording", """
r AS (SELECT dataset_id, min(value) AS lo, (CASE WHEN max(value) = min(value) THEN min(value) + 1 ELSE max(value) END
             - min(value)) / 10 AS width FROM ev GROUP BY 1),
b AS (SELECT ev.dataset_id, least(CAST(floor((value - lo) / width) AS INT), 9) AS bin, count(*) AS n
      FROM ev JOIN r USING (dataset_id) GROUP BY 1, 2)
SELECT r.dataset_id, CAST(g AS INT) AS bin, round(lo + width * g, 6) AS lower, round(lo + width * (g + 1), 6) AS upper,
       coalesce(n, 0) AS "count" FROM r CROSS JOIN range(10) t(g)
LEFT JOIN b ON b.dataset_id = r.dataset_id AND b.bin = g""")
def histogram_per_recording(spark, sf):
    return rounded(bins.histogram(tables.events(spark, sf), "value", 10, keys=["dataset_id"]))


@query("histogram_categories", """
SELECT label, n AS "count", CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS axis FROM
 (SELECT CAST(k AS VARCHAR) AS label, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, label LIMIT 40)""")
def histogram_categories(spark, sf):
    return bins.category_histogram(tables.events(spark, sf).withColumn("k", F.col("k").cast("string")), "k")


@query("histogram_extreme_numbers", """
SELECT label, n AS "count", CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS INT) AS axis FROM
 (SELECT CAST(v AS VARCHAR) AS label, count(*) AS n FROM
   (SELECT CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN l_quantity * CAST(1e15 AS DOUBLE) WHEN 1 THEN l_quantity / CAST(1048576 AS DOUBLE)
      WHEN 2 THEN -l_quantity * CAST(1e120 AS DOUBLE) WHEN 3 THEN l_quantity * CAST(1e6 AS DOUBLE) ELSE l_quantity END AS v FROM lineitem)
  GROUP BY 1 ORDER BY n DESC, label LIMIT 40)""")
def histogram_extreme_numbers(spark, sf):
    """Labels of very large and very small doubles."""
    quantity, style = F.col("l_quantity"), F.col("l_quantity").cast("int") % 5
    value = (F.when(style == 0, quantity * 1e15).when(style == 1, quantity / 1048576.0).when(style == 2, -quantity * 1e120)
             .when(style == 3, quantity * 1e6).otherwise(quantity))
    return bins.category_histogram(tables.table(spark, sf, "lineitem").select(value.alias("v")), "v")


@query("density_2d", """
r AS (SELECT min(value) AS lx, (max(value) - min(value)) / 20 AS wx, min(k) AS ly, (max(k) - min(k)) / 20.0::DOUBLE AS wy FROM ev),
c AS (SELECT least(CAST(floor((value - lx) / wx) AS INT), 19) AS bin_x, least(CAST(floor((k - ly) / wy) AS INT), 19) AS bin_y,
             lx, wx, ly, wy FROM ev, r)
SELECT bin_x, bin_y, count(*) AS "count", round(first(lx) + first(wx) * bin_x, 6) AS lower_x,
       round(first(ly) + first(wy) * bin_y, 6) AS lower_y FROM c GROUP BY 1, 2""")
def density_2d(spark, sf):
    return rounded(bins.density(tables.events(spark, sf), "value", "k", 20))
