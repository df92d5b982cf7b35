"""Comparison of recordings and chart-builder aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts, compare
from . import tables
from .registry import query, rounded


@query("compare_histogram", """
r AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS width FROM li),
c AS (SELECT dataset_id, least(CAST(floor((l_extendedprice - lo) / width) AS INT), 29) AS bin, count(*) AS n FROM li, r GROUP BY ALL),
g AS (SELECT dataset_id, CAST(b AS INT) AS bin FROM (SELECT DISTINCT dataset_id FROM li) CROSS JOIN range(30) t(b)),
f AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (dataset_id, bin))
SELECT dataset_id, bin, round(lo + width * bin, 4) AS lower, round(lo + width * (bin + 1), 4) AS upper, n AS "count",
       round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset_id), 3) AS percent FROM f, r""")
def compare_histogram(spark, sf):
    out = compare.compare_histogram(tables.lineitem(spark, sf), "l_extendedprice", 30)
    return rounded(out, 4)


@query("compare_categories", """
c AS (SELECT dataset_id, CAST(k AS VARCHAR) AS label, count(*) AS n FROM ev GROUP BY ALL),
t AS (SELECT label, sum(n) AS total, row_number() OVER (ORDER BY sum(n) DESC, label) AS place FROM c GROUP BY label),
x AS (SELECT label, CAST(row_number() OVER (ORDER BY CAST(label AS DOUBLE)) - 1 AS INT) AS axis FROM t WHERE place <= 40),
z AS (SELECT dataset_id, sum(n) AS n FROM c GROUP BY 1)
SELECT z.dataset_id, x.label, x.axis, coalesce(c.n, 0)::BIGINT AS "count",
       round(coalesce(c.n, 0) * 100.0::DOUBLE / z.n, 3) AS percent
FROM z CROSS JOIN x LEFT JOIN c ON c.dataset_id = z.dataset_id AND c.label = x.label""")
def compare_categories(spark, sf):
    """A numeric signal compared as categories: labels in numeric order."""
    return rounded(compare.compare_histogram(tables.events(spark, sf), "k", as_category=True))


@query("compare_group_stats", """
s AS (SELECT dataset_id, CAST(l_linenumber AS VARCHAR) AS "group", count(*) AS "count", avg(l_quantity) AS "avg",
  min(l_quantity) AS "min", max(l_quantity) AS "max", quantile_cont(l_quantity, 0.25) AS q1,
  quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3 FROM su GROUP BY ALL)
SELECT dataset_id, "group", "count", round("avg", 6) AS "avg", "min", "max", round(q1, 6) AS q1, round(median, 6) AS median,
  round(q3, 6) AS q3, round(greatest("min", q1 - 1.5 * (q3 - q1)), 6) AS lowerfence,
  round(least("max", q3 + 1.5 * (q3 - q1)), 6) AS upperfence, CAST("group" AS INT) - 1 AS axis FROM s""")
def compare_group_stats(spark, sf):
    return rounded(compare.compare_group_stats(tables.supplies(spark, sf), "l_quantity", "l_linenumber"), 6)


@query("compare_summary", """
SELECT dataset_id, count(value) AS "count", round(avg(value), 8) AS "avg", round(stddev_samp(value), 8) AS std, min(value) AS "min",
  max(value) AS "max", round(quantile_cont(value, 0.25), 8) AS q25, round(quantile_cont(value, 0.5), 8) AS q50,
  round(quantile_cont(value, 0.75), 8) AS q75 FROM ev GROUP BY dataset_id""")
def compare_summary(spark, sf):
    return rounded(compare.compare_summary(tables.events(spark, sf), "value"), 8)


@query("compare_summary_by_rank", """
SELECT dataset_id, round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50,
  round(quantile_cont(l_extendedprice, 0.75), 4) AS q75 FROM li GROUP BY dataset_id""")
def compare_summary_by_rank(spark, sf):
    """Exact quartiles of recordings too large for one task: from sorted cumulative counts."""
    from ..operators.quantiles import quantiles

    rows = tables.lineitem(spark, sf).select("dataset_id", "l_extendedprice")
    q = quantiles(rows, ["dataset_id"], "l_extendedprice", [0.25, 0.5, 0.75], "q", in_memory=False)
    return rounded(q.select("dataset_id", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]), 4)


@query("compare_curve", """
r AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 25 AS width FROM li),
b AS (SELECT dataset_id, least(CAST(floor((l_quantity - lo) / width) AS INT), 24) AS bin, count(*) AS n, avg(l_extendedprice) AS m,
  quantile_cont(l_extendedprice, 0.1) AS p10, quantile_cont(l_extendedprice, 0.9) AS p90 FROM li, r GROUP BY ALL),
g AS (SELECT dataset_id, CAST(b AS INT) AS bin FROM (SELECT DISTINCT dataset_id FROM li) CROSS JOIN range(25) t(b))
SELECT g.dataset_id, g.bin, round(lo + width * (g.bin + 0.5), 4) AS center, coalesce(n, 0) AS "count", round(m, 4) AS mean,
  round(p10, 4) AS p10, round(p90, 4) AS p90 FROM g CROSS JOIN r LEFT JOIN b USING (dataset_id, bin)""")
def compare_curve(spark, sf):
    return rounded(compare.compare_curve(tables.lineitem(spark, sf), "l_quantity", "l_extendedprice", 25), 4)


@query("compare_cdf", """
q AS (SELECT dataset_id, quantile_cont(l_extendedprice, list_transform(range(101), lambda i: i / 100.0::DOUBLE)) AS v
      FROM li GROUP BY dataset_id)
SELECT dataset_id, CAST(unnest(range(101)) AS INT) AS percent, round(unnest(v), 4) AS value FROM q""")
def compare_cdf(spark, sf):
    return rounded(compare.compare_cdf(tables.lineitem(spark, sf), "l_extendedprice"), 4)


_SIGNALS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("difference_scan", """
u AS (""" + " UNION ALL ".join(f"SELECT dataset_id, '{c}' AS signal, avg({c}) AS a FROM li GROUP BY 1" for c in _SIGNALS) + """)
SELECT o.signal, o.dataset_id, round(o.a, 6) AS "avg", round(b.a, 6) AS base_avg,
       round((o.a - b.a) * 100 / abs(b.a), 2) AS delta_pct
FROM u o JOIN u b ON b.signal = o.signal AND b.dataset_id = 'AF' WHERE o.dataset_id <> 'AF'""")
def difference_scan(spark, sf):
    out = compare.compare_diff(tables.lineitem(spark, sf), "AF", columns=_SIGNALS)
    return rounded(out.select("signal", "dataset_id", "avg", "base_avg", "delta_pct"))


@query("difference_rank", """
one AS (""" + " UNION ALL ".join(f"""
  SELECT '{c}' AS signal, dataset_id, quantile_cont({c}, list_transform(range(1, 100), lambda i: i / 100.0::DOUBLE)) AS q
  FROM li GROUP BY dataset_id""" for c in _SIGNALS) + """),
pt AS (SELECT signal, dataset_id, unnest(range(1, 100)) AS i, unnest(q) AS v FROM one),
pair AS (SELECT DISTINCT signal, dataset_id AS other FROM one WHERE dataset_id <> 'AF'),
grid AS (SELECT DISTINCT p.signal, p.other, t.v AS g FROM pair p JOIN pt t
         ON t.signal = p.signal AND (t.dataset_id = p.other OR t.dataset_id = 'AF')),
below AS (SELECT g.signal, g.other, g.g, t.dataset_id = 'AF' AS is_base, max(t.i) FILTER (WHERE t.v <= g.g) AS i0,
    min(t.i) FILTER (WHERE t.v > g.g) AS i1, max(t.v) FILTER (WHERE t.v <= g.g) AS v0, min(t.v) FILTER (WHERE t.v > g.g) AS v1
  FROM grid g JOIN pt t ON t.signal = g.signal AND (t.dataset_id = g.other OR t.dataset_id = 'AF') GROUP BY ALL),
f AS (SELECT signal, other, g, is_base, CASE WHEN i0 IS NULL THEN 0.0 WHEN i1 IS NULL THEN CASE WHEN v0 < g THEN 1.0 ELSE 0.99 END
    ELSE (i0 + (i1 - i0) * (g - v0) / (v1 - v0)) / 100.0 END::DOUBLE AS c FROM below),
ks AS (SELECT signal, other, round(max(abs(c1 - c0)), 4) AS ks FROM
  (SELECT signal, other, g, max(c) FILTER (WHERE is_base) AS c0, max(c) FILTER (WHERE NOT is_base) AS c1 FROM f GROUP BY ALL)
  GROUP BY ALL),
best AS (SELECT signal, max(ks) AS max_ks FROM ks GROUP BY 1)
SELECT signal, other AS dataset_id, ks, max_ks FROM ks JOIN best USING (signal)""")
def difference_rank(spark, sf):
    """KS distance of the quantile curves and the ranking of the signals."""
    out = compare.compare_diff(tables.lineitem(spark, sf), "AF", columns=_SIGNALS)
    return out.select("signal", "dataset_id", "ks", "max_ks")


@query("exact_ks", """
w AS (SELECT DISTINCT o.dataset_id AS other, v.l_extendedprice AS v FROM (SELECT DISTINCT dataset_id FROM li WHERE dataset_id <> 'AF') o
      JOIN li v ON v.dataset_id = o.dataset_id OR v.dataset_id = 'AF'),
c AS (SELECT dataset_id, l_extendedprice AS v, count(*) AS n FROM li GROUP BY ALL),
j AS (SELECT w.other, w.v, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM w
  LEFT JOIN c a ON a.dataset_id = w.other AND a.v = w.v LEFT JOIN c b ON b.dataset_id = 'AF' AND b.v = w.v),
s AS (SELECT other, sum(a) OVER o / sum(a) OVER (PARTITION BY other) AS fa, sum(b) OVER o / sum(b) OVER (PARTITION BY other) AS fb
      FROM j WINDOW o AS (PARTITION BY other ORDER BY v))
SELECT other AS dataset_id, round(max(abs(fa - fb)), 6) AS ks FROM s GROUP BY 1""")
def exact_ks(spark, sf):
    return rounded(compare.exact_ks(tables.lineitem(spark, sf), "l_extendedprice", "AF"))


@query("bar_average", """
c AS (SELECT CAST(l_linenumber AS VARCHAR) AS category, l_returnflag AS color, avg(l_extendedprice) AS value, count(*) AS n
      FROM lineitem GROUP BY ALL)
SELECT color, category, CAST(category AS INT) - 1 AS axis, round(value, 4) AS value, n FROM c""")
def bar_average(spark, sf):
    return rounded(charts.bar(tables.table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice", "l_returnflag"), 4)


@query("bar_share", """
c AS (SELECT CAST(k AS VARCHAR) AS category, event_type AS color, count(*) AS n FROM ev GROUP BY ALL),
t AS (SELECT category, row_number() OVER (ORDER BY sum(n) DESC, category) AS place FROM c GROUP BY 1),
x AS (SELECT category, CAST(row_number() OVER (ORDER BY CAST(category AS DOUBLE)) - 1 AS INT) AS axis FROM t WHERE place <= 40),
s AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY color) AS value FROM c)
SELECT color, category, axis, round(value, 3) AS value, n FROM s JOIN x USING (category)""")
def bar_share(spark, sf):
    return charts.bar(tables.events(spark, sf), "k", None, "event_type", "share")


@query("bar_median_per_recording", """
c AS (SELECT dataset_id, CAST(l_linenumber AS VARCHAR) AS category, quantile_cont(l_tax, 0.5) AS value, count(*) AS n FROM li GROUP BY ALL)
SELECT dataset_id, '' AS color, category, CAST(category AS INT) - 1 AS axis, round(value, 6) AS value, n FROM c""")
def bar_median_per_recording(spark, sf):
    return rounded(charts.bar(tables.lineitem(spark, sf), "l_linenumber", "l_tax", None, "median", keys=["dataset_id"]))


@query("box_by_color", """
s AS (SELECT o_orderstatus AS color, o_orderpriority AS category, count(*) AS "count", avg(o_totalprice) AS "avg", min(o_totalprice) AS mn,
  max(o_totalprice) AS mx, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY ALL)
SELECT color, category, "count", round("avg", 4) AS "avg", round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(greatest(mn, q1 - 1.5 * (q3 - q1)), 4) AS lowerfence, round(least(mx, q3 + 1.5 * (q3 - q1)), 4) AS upperfence,
  CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS axis FROM s""")
def box_by_color(spark, sf):
    return rounded(charts.box(tables.table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "o_orderstatus"), 4)


@query("histogram_by_color", """
r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS width FROM ev),
c AS (SELECT event_type AS color, least(CAST(floor((value - lo) / width) AS INT), 19) AS bin, count(*) AS n FROM ev, r GROUP BY ALL),
g AS (SELECT color, CAST(b AS INT) AS bin FROM (SELECT DISTINCT event_type AS color FROM ev) CROSS JOIN range(20) t(b)),
f AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (color, bin))
SELECT color, bin, round(lo + width * bin, 6) AS lower, round(lo + width * (bin + 1), 6) AS upper, n AS "count",
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY color), 3) AS percent FROM f, r""")
def histogram_by_color(spark, sf):
    return rounded(charts.histogram_by_color(tables.events(spark, sf), "value", "event_type", 20))


@query("categories_by_color", """
c AS (SELECT o_orderpriority AS label, o_orderstatus AS color, count(*) AS n FROM orders GROUP BY ALL),
x AS (SELECT label, CAST(row_number() OVER (ORDER BY sum(n) DESC, label) - 1 AS INT) AS axis FROM c GROUP BY label)
SELECT color, label, axis, n AS "count", round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY color), 3) AS percent
FROM c JOIN x USING (label)""")
def categories_by_color(spark, sf):
    return charts.histogram_by_color(tables.table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("heatmap", """
r AS (SELECT min(l_quantity) AS lx, (max(l_quantity) - min(l_quantity)) / 15 AS wx, min(l_extendedprice) AS ly,
             (max(l_extendedprice) - min(l_extendedprice)) / 15 AS wy FROM lineitem),
c AS (SELECT least(CAST(floor((l_quantity - lx) / wx) AS INT), 14) AS bin_x, least(CAST(floor((l_extendedprice - ly) / wy) AS INT), 14) AS bin_y
      FROM lineitem, r)
SELECT bin_x, bin_y, count(*) AS "count" FROM c GROUP BY ALL""")
def heatmap(spark, sf):
    out = charts.heatmap(tables.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 15)
    return out.select("bin_x", "bin_y", "count")


@query("line_points", """
n AS (SELECT ts, value, event_type, row_pos, row_number() OVER (ORDER BY ts, row_pos) AS rn, count(*) OVER () AS total_rows FROM ev),
s AS (SELECT *, greatest(1, CAST(ceil(total_rows / 1000.0) AS BIGINT)) AS stride FROM n)
SELECT * FROM s WHERE (rn - 1) % stride = 0""")
def line_points(spark, sf):
    return charts.points(tables.events(spark, sf), "line", "ts", "value", "event_type", max_points=1000)


# group mode: cohorts A, B and C of the catalog as chart groups


def _members(spark, sf):
    from ..operators.cohorts import membership

    return membership(tables.catalog(spark, sf), tables.SPECS).select(F.col("cohort").alias("label"), "dataset_id")


@query("group_bar", """
p AS (SELECT cohort AS label, CAST(event_type AS VARCHAR) AS category, value FROM ev JOIN mem USING (dataset_id)),
c AS (SELECT label, category, avg(value) AS value, count(*) AS n FROM p GROUP BY ALL)
SELECT label, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS axis, round(value, 8) AS value, n FROM c""")
def group_bar(spark, sf):
    return rounded(charts.group_bar(tables.events(spark, sf), _members(spark, sf), "event_type", "value"), 8)


@query("group_box", """
p AS (SELECT cohort AS label, event_type AS category, value FROM ev JOIN mem USING (dataset_id) WHERE k >= 20.0),
s AS (SELECT label, category, count(*) AS "count", avg(value) AS "avg", min(value) AS mn, max(value) AS mx,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM p GROUP BY ALL)
SELECT label, category, "count", round("avg", 8) AS "avg", round(q1, 8) AS q1, round(median, 8) AS median, round(q3, 8) AS q3,
  round(greatest(mn, q1 - 1.5 * (q3 - q1)), 8) AS lowerfence, round(least(mx, q3 + 1.5 * (q3 - q1)), 8) AS upperfence,
  CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS axis FROM s""")
def group_box(spark, sf):
    only = [{"column": "k", "op": "ge", "value": 20}]
    return rounded(charts.group_box(tables.events(spark, sf), _members(spark, sf), "event_type", "value", only), 8)


@query("group_histogram", """
p AS (SELECT cohort AS label, value FROM ev JOIN mem USING (dataset_id)),
r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS width FROM p),
c AS (SELECT label, least(CAST(floor((value - lo) / width) AS INT), 19) AS bin, count(*) AS n FROM p, r GROUP BY ALL),
g AS (SELECT label, CAST(b AS INT) AS bin FROM (SELECT DISTINCT label FROM p) CROSS JOIN range(20) t(b)),
f AS (SELECT g.*, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (label, bin))
SELECT label, bin, round(lo + width * bin, 6) AS lower, round(lo + width * (bin + 1), 6) AS upper, n AS "count",
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY label), 3) AS percent FROM f, r""")
def group_histogram(spark, sf):
    return rounded(charts.group_histogram(tables.events(spark, sf), _members(spark, sf), "value", 20))


@query("group_categories", """
p AS (SELECT cohort AS label, event_type AS category, count(*) AS n FROM ev JOIN mem USING (dataset_id) GROUP BY ALL)
SELECT label, category, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INT) AS axis, n AS "count",
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY label), 3) AS percent FROM p""")
def group_categories(spark, sf):
    return charts.group_histogram(tables.events(spark, sf), _members(spark, sf), "event_type")


@query("group_heatmap", """
p AS (SELECT cohort AS label, value, k FROM ev JOIN mem USING (dataset_id)),
r AS (SELECT min(value) AS lx, (max(value) - min(value)) / 10 AS wx, min(k) AS ly, (max(k) - min(k)) / 10.0::DOUBLE AS wy FROM p),
c AS (SELECT label, least(CAST(floor((value - lx) / wx) AS INT), 9) AS bin_x, least(CAST(floor((k - ly) / wy) AS INT), 9) AS bin_y,
  count(*) AS n FROM p, r GROUP BY ALL)
SELECT label, bin_x, bin_y, n AS "count", round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY label), 5) AS percent FROM c""")
def group_heatmap(spark, sf):
    out = charts.group_heatmap(tables.events(spark, sf), _members(spark, sf), "value", "k", 10)
    return out.select("label", "bin_x", "bin_y", "count", "percent")


@query("group_line_points", """
p AS (SELECT cohort AS label, elapsed, value, dataset_id, row_pos FROM ev JOIN mem USING (dataset_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY elapsed, dataset_id, row_pos) AS rn, count(*) OVER (PARTITION BY label) AS total_rows FROM p),
s AS (SELECT *, greatest(1, CAST(ceil(total_rows / 200.0) AS BIGINT)) AS stride FROM n)
SELECT label, round(elapsed, 6) AS elapsed, value, dataset_id, row_pos, rn, total_rows, stride FROM s WHERE (rn - 1) % stride = 0""")
def group_line_points(spark, sf):
    out = charts.group_points(tables.events(spark, sf), _members(spark, sf), "line", "elapsed", "value", max_points=600)
    return rounded(out)


@query("group_stats", """
SELECT cohort AS label, count(value) AS "count", round(avg(value), 8) AS "avg", round(stddev_samp(value), 8) AS std, min(value) AS "min",
  max(value) AS "max", round(quantile_cont(value, 0.5), 8) AS median FROM ev JOIN mem USING (dataset_id) GROUP BY 1""")
def group_stats(spark, sf):
    return rounded(charts.group_stats(tables.events(spark, sf), _members(spark, sf), "value"), 8)
