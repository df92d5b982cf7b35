"""Cohort comparisons, tests, events, transitions, regression, correlation, components and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, models, regression, sequences, spectrum, stat_tests
from . import tables
from .registry import query, rounded


def _members(spark, sf):
    return cohorts.membership(tables.catalog(spark, sf), tables.SPECS)


@query("cohort_membership", "SELECT cohort, position, dataset_id, row_count FROM mem JOIN cat USING (dataset_id)")
def cohort_membership(spark, sf):
    return _members(spark, sf).select("cohort", "position", "dataset_id", "row_count")


@query("cohort_sizes", """
SELECT cohort, position, count(*) AS dataset_count, sum(row_count)::BIGINT AS row_count
FROM mem JOIN cat USING (dataset_id) GROUP BY ALL""")
def cohort_sizes(spark, sf):
    return cohorts.resolve(tables.catalog(spark, sf), tables.SPECS)


@query("cohort_overlaps", """
SELECT dataset_id, string_agg(cohort, ',' ORDER BY position) AS cohorts FROM mem GROUP BY 1 HAVING count(*) > 1""")
def cohort_overlaps(spark, sf):
    out = cohorts.overlaps(_members(spark, sf))
    return out.select("dataset_id", F.array_join("cohorts", ",").alias("cohorts"))


@query("cohort_dataset_ids", "SELECT DISTINCT dataset_id FROM mem")
def cohort_dataset_ids(spark, sf):
    return cohorts.dataset_ids(_members(spark, sf))


@query("cohort_histogram", """
i AS (SELECT * FROM ev WHERE dataset_id IN (SELECT dataset_id FROM mem)),
r AS (SELECT min(value) AS lo, (max(value) - min(value)) / 25 AS width FROM i),
c AS (SELECT dataset_id, least(CAST(floor((value - lo) / width) AS INT), 24) AS bin, count(*) AS n FROM i, r GROUP BY ALL),
p AS (SELECT dataset_id, bin, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset_id), 3) AS pc FROM c),
g AS (SELECT cohort, position, dataset_id, CAST(b AS INT) AS bin FROM mem CROSS JOIN range(25) t(b)),
f AS (SELECT g.cohort, g.bin, sum(coalesce(n, 0)) AS n, round((sum(coalesce(pc, 0)::DECIMAL(18,6)) / count(*))::DECIMAL(20,10), 6)::DOUBLE AS mean_percent
      FROM g LEFT JOIN p USING (dataset_id, bin) GROUP BY ALL)
SELECT cohort, bin, round(lo + width * bin, 6) AS lower, round(lo + width * (bin + 1), 6) AS upper, n::BIGINT AS "count", mean_percent,
  sum(n) OVER (PARTITION BY cohort)::BIGINT AS total_points, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY cohort), 6) AS pooled_percent
FROM f, r""")
def cohort_histogram(spark, sf):
    return rounded(cohorts.cohort_histogram(tables.events(spark, sf), _members(spark, sf), "value", 25))


@query("cohort_categories", """
c AS (SELECT dataset_id, event_type AS label, count(*) AS n FROM ev WHERE dataset_id IN (SELECT dataset_id FROM mem) GROUP BY ALL),
x AS (SELECT label, CAST(row_number() OVER (ORDER BY sum(n) DESC, label) - 1 AS INT) AS axis FROM c GROUP BY 1),
p AS (SELECT dataset_id, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset_id), 3) AS pc FROM c),
f AS (SELECT cohort, x.label, axis, sum(coalesce(n, 0)) AS n, round((sum(coalesce(pc, 0)::DECIMAL(18,6)) / count(*))::DECIMAL(20,10), 6)::DOUBLE AS mean_percent
      FROM mem CROSS JOIN x LEFT JOIN p ON p.dataset_id = mem.dataset_id AND p.label = x.label GROUP BY ALL)
SELECT cohort, label, axis, n::BIGINT AS "count", mean_percent, sum(n) OVER (PARTITION BY cohort)::BIGINT AS total_points,
  round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY cohort), 6) AS pooled_percent FROM f""")
def cohort_categories(spark, sf):
    return rounded(cohorts.cohort_histogram(tables.events(spark, sf), _members(spark, sf), "event_type"))


@query("cohort_histogram2d", """
i AS (SELECT * FROM ev WHERE dataset_id IN (SELECT dataset_id FROM mem)),
r AS (SELECT min(value) AS lx, (max(value) - min(value)) / 8 AS wx, min(k) AS ly, (max(k) - min(k)) / 6.0::DOUBLE AS wy FROM i),
c AS (SELECT dataset_id, greatest(0, least(CAST(floor((value - lx) / wx) AS INT), 7)) AS bin_x,
        greatest(0, least(CAST(floor((k - ly) / wy) AS INT), 5)) AS bin_y, count(*) AS n FROM i, r GROUP BY ALL),
p AS (SELECT *, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY dataset_id), 6) AS pc FROM c),
s AS (SELECT cohort, count(*) AS members FROM mem GROUP BY 1),
f AS (SELECT cohort, bin_x, bin_y, sum(n) AS n, sum(pc::DECIMAL(18,6)) AS pcs FROM p JOIN mem USING (dataset_id) GROUP BY ALL)
SELECT cohort, bin_x, bin_y, n::BIGINT AS "count", round((pcs / members)::DECIMAL(20,10), 6)::DOUBLE AS mean_percent,
  sum(n) OVER (PARTITION BY cohort)::BIGINT AS total_points, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY cohort), 6) AS pooled_percent
FROM f JOIN s USING (cohort)""")
def cohort_histogram2d(spark, sf):
    out = cohorts.cohort_histogram2d(tables.events(spark, sf), _members(spark, sf), "value", "k", 8, 6)
    return rounded(out.drop("lower_x", "lower_y"))


@query("cohort_summary", """
v AS (SELECT dataset_id, quantile_cont(value, 0.75) AS v FROM ev GROUP BY 1)
SELECT 'value' AS signal, cohort, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS "min",
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75,
  round(max(v), 6) AS "max" FROM v JOIN mem USING (dataset_id) GROUP BY cohort""")
def cohort_summary(spark, sf):
    return rounded(cohorts.cohort_summary(tables.events(spark, sf), _members(spark, sf), ["value"], "q75"))


@query("cohort_multi_summary", """
v AS (SELECT dataset_id, 'value' AS signal, avg(value) AS v FROM ev GROUP BY 1 UNION ALL
      SELECT dataset_id, 'k', avg(k) FROM ev GROUP BY 1)
SELECT signal, cohort, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS "min",
  round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75,
  round(max(v), 6) AS "max" FROM v JOIN mem USING (dataset_id) GROUP BY signal, cohort""")
def cohort_multi_summary(spark, sf):
    """Several signals in one job."""
    return rounded(cohorts.cohort_summary(tables.events(spark, sf), _members(spark, sf), ["value", "k"]))


@query("cohort_effects", """
v AS (SELECT dataset_id, 'value' AS signal, avg(value) AS v FROM ev GROUP BY 1 UNION ALL
      SELECT dataset_id, 'k', avg(k) FROM ev GROUP BY 1),
s AS (SELECT signal, cohort, position, v FROM v JOIN mem USING (dataset_id)),
m AS (SELECT signal, cohort, position, count(v) AS n, avg(v) AS mean, var_samp(v) AS var FROM s GROUP BY ALL),
d AS (SELECT r.signal, r.cohort AS comparison, l.n AS nl, r.n AS nr, l.mean AS ml, r.mean AS mr,
        sqrt(((l.n - 1) * l.var + (r.n - 1) * r.var) / (l.n + r.n - 2)) AS sp FROM m l JOIN m r ON l.signal = r.signal
      AND l.position = 0 AND r.position > 0),
c AS (SELECT r.signal, r.cohort AS comparison, sum(sign(r.v - l.v)) / count(*) AS cliffs FROM s l JOIN s r ON l.signal = r.signal
      AND l.position = 0 AND r.position > 0 GROUP BY ALL),
g AS (SELECT d.*, cliffs, (1 - 3.0::DOUBLE / (4 * (nl + nr - 2) - 1)) * (mr - ml) / sp AS g FROM d JOIN c USING (signal, comparison))
SELECT signal, comparison, nl AS n_left, nr AS n_right, round(mr - ml, 6) AS difference,
  round((mr - ml) * 100 / abs(ml), 6) AS difference_percent, round(g, 6) AS hedges_g, round(cliffs, 6) AS cliffs_delta,
  CASE WHEN abs(g) >= 0.8 THEN 'large' WHEN abs(g) >= 0.5 THEN 'medium' ELSE 'small' END AS effect_size FROM g""")
def cohort_effects(spark, sf):
    values = cohorts.representative_values(tables.events(spark, sf), _members(spark, sf), ["value", "k"])
    out = stat_tests.compare_cohorts(values, with_bootstrap=False)
    return rounded(out.select("signal", "comparison", "n_left", "n_right", "difference", "difference_percent", "hedges_g",
                              "cliffs_delta", "effect_size"))


@query("cohort_tests")
def cohort_tests(spark, sf):
    """Welch and Mann-Whitney p values and the bootstrap interval of the difference of means."""
    values = cohorts.representative_values(tables.events(spark, sf), _members(spark, sf), ["value", "k"])
    out = stat_tests.compare_cohorts(values)
    return out.select("signal", "comparison", "t_test_p", "mann_whitney_p", "t_significant", "mw_significant",
                      "ci95_low", "ci95_high")


_RUNS = """
o AS (SELECT dataset_id, row_pos, event_type, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY dataset_id ORDER BY ts, row_pos) AS i
      FROM ev WHERE k >= 5.0),
u AS (SELECT *, i - row_number() OVER (PARTITION BY dataset_id, event_type ORDER BY i) AS run FROM o),
e AS (SELECT dataset_id, min(t) AS start, max(t) - min(t) AS duration, count(*) AS "rows", avg(value) AS secondary
      FROM u WHERE event_type = 'click' GROUP BY dataset_id, run)"""
_LATE = [{"column": "k", "op": "ge", "value": 5}]


@query("state_events", _RUNS + """
SELECT dataset_id, round(start, 3) AS start, round(duration, 3) AS duration, "rows", round(secondary, 6) AS secondary,
  CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY start) AS INT) AS event FROM e""")
def state_events(spark, sf):
    out = sequences.events(tables.events(spark, sf), "event_type", "click", "ts", secondary="value", filters=_LATE)
    return out.select("dataset_id", F.round("start", 3).alias("start"), F.round("duration", 3).alias("duration"), "rows",
                      F.round("secondary", 6).alias("secondary"), "event")


@query("event_summary", _RUNS + """,
s AS (SELECT cohort, count(*) AS source_rows FROM o JOIN mem USING (dataset_id) GROUP BY 1)
SELECT cohort, source_rows, count(*) AS event_count, round(count(*) * 1000.0::DOUBLE / source_rows, 3) AS events_per_1k_rows,
  round(avg(duration), 3) AS mean, round(stddev_samp(duration), 3) AS std, round(max(duration), 3) AS "max",
  round(quantile_cont(duration, 0.5), 3) AS median, round(quantile_cont(duration, 0.9), 3) AS p90, round(avg(secondary), 6) AS secondary_mean
FROM e JOIN mem USING (dataset_id) JOIN s USING (cohort) GROUP BY cohort, source_rows""")
def event_summary(spark, sf):
    out = sequences.event_summary(tables.events(spark, sf), _members(spark, sf), "event_type", "click", "ts",
                                  secondary="value", filters=_LATE)
    return out.select("cohort", "source_rows", "event_count", "events_per_1k_rows",
                      *[F.round(c, 3).alias(c) for c in ("mean", "std", "max", "median", "p90")],
                      F.round("secondary_mean", 6).alias("secondary_mean"))


_STEPS = """
o AS (SELECT dataset_id, event_type AS state, lag(event_type) OVER (PARTITION BY dataset_id ORDER BY ts, row_pos) AS previous FROM ev),
c AS (SELECT dataset_id, previous, state, count(*) AS n FROM o WHERE previous <> state GROUP BY ALL)"""


@query("state_transitions", _STEPS + ' SELECT dataset_id, previous, state, n AS "count" FROM c')
def state_transitions(spark, sf):
    return sequences.transitions(tables.events(spark, sf), "event_type", "ts")


@query("state_transitions_in_chunks", """
o AS (SELECT dataset_id, o_orderstatus AS state, lag(o_orderstatus) OVER (PARTITION BY dataset_id ORDER BY o_orderdate, row_pos) AS previous FROM od)
SELECT dataset_id, previous, state, count(*) AS "count" FROM o WHERE previous <> state GROUP BY ALL""")
def state_transitions_in_chunks(spark, sf):
    """Transitions with every recording spread over range chunks, as a recording too large for one task is."""
    from ..operators.ordered import Ordered

    rows = tables.orders(spark, sf).select("dataset_id", "row_pos", "o_orderdate", F.col("o_orderstatus").alias("state"))
    steps = Ordered(rows, ["dataset_id"], ["o_orderdate", "row_pos"], split=True).lag({"previous": "state"}).df
    changes = steps.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("state")))
    return changes.groupBy("dataset_id", "previous", "state").agg(F.count(F.lit(1)).alias("count"))


_RATES = _STEPS + """,
t AS (SELECT previous || '→' || state AS transition, sum(n) AS total FROM c
      WHERE dataset_id IN (SELECT dataset_id FROM mem) GROUP BY 1),
z AS (SELECT dataset_id, {den} AS den, count(*) AS n FROM ev GROUP BY 1),
h AS (SELECT cohort, sum(den) AS den, count(*) AS members, sum(n) AS source_rows FROM mem JOIN z USING (dataset_id) GROUP BY 1),
k AS (SELECT cohort, previous || '→' || state AS transition, sum(c.n) AS n, sum(c.n * {scale} / den) AS rates
      FROM c JOIN mem USING (dataset_id) JOIN z USING (dataset_id) GROUP BY ALL)
SELECT h.cohort, t.transition, total::BIGINT AS total, coalesce(n, 0)::BIGINT AS "count", source_rows::BIGINT AS source_rows,
  round(coalesce(n, 0) * {scale} / den, 6) AS pooled_rate, round(coalesce(rates, 0) / members, 6) AS mean_rate
FROM h CROSS JOIN t LEFT JOIN k ON k.cohort = h.cohort AND k.transition = t.transition"""


@query("transition_rates", _RATES.format(den="count(*)", scale="1000.0::DOUBLE"))
def transition_rates(spark, sf):
    return rounded(sequences.transition_rates(tables.events(spark, sf), _members(spark, sf), "event_type", "ts"))


@query("transition_rates_per_span", _RATES.format(den="max(elapsed) - min(elapsed)", scale="86400.0::DOUBLE"))
def transition_rates_per_span(spark, sf):
    """Transitions per day of recording."""
    return rounded(sequences.transition_rates(tables.events(spark, sf), _members(spark, sf), "event_type", "ts",
                                              denominator="elapsed", scale=86400.0))


@query("cohort_regression", """
SELECT cohort, round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 6) AS intercept, round(regr_r2(value, k), 6) AS r2,
  count(*) AS n, min(k)::DOUBLE AS min_x, max(k)::DOUBLE AS max_x, round(regr_slope(value, k) * min(k) + regr_intercept(value, k), 6) AS fit_min_x,
  round(regr_slope(value, k) * max(k) + regr_intercept(value, k), 6) AS fit_max_x FROM ev JOIN mem USING (dataset_id) GROUP BY cohort""")
def cohort_regression(spark, sf):
    return rounded(regression.cohort_regression(tables.events(spark, sf), _members(spark, sf), "k", "value"))


@query("regression_points", """
n AS (SELECT cohort, dataset_id, row_pos, k, value, row_number() OVER (PARTITION BY cohort ORDER BY dataset_id, row_pos) AS rn,
        count(*) OVER (PARTITION BY cohort) AS total_rows FROM ev JOIN mem USING (dataset_id)),
s AS (SELECT *, greatest(1, total_rows // 3000) AS stride FROM n)
SELECT * FROM s WHERE (rn - 1) % stride = 0""")
def regression_points(spark, sf):
    return regression.regression_points(tables.events(spark, sf), _members(spark, sf), "k", "value")


@query("cohort_correlation", """
p AS (SELECT cohort, 'value' AS a, 'k' AS b, corr(value, k) AS r FROM ev JOIN mem USING (dataset_id) GROUP BY 1
  UNION ALL SELECT cohort, 'value', 'lat', corr(value, lat) FROM ev JOIN mem USING (dataset_id) GROUP BY 1
  UNION ALL SELECT cohort, 'k', 'lat', corr(k, lat) FROM ev JOIN mem USING (dataset_id) GROUP BY 1)
SELECT cohort, a, b, round(r, 6) AS r FROM p UNION ALL SELECT cohort, b, a, round(r, 6) FROM p
UNION ALL SELECT cohort, x, x, 1.0 FROM (SELECT DISTINCT cohort FROM mem) CROSS JOIN (SELECT unnest(['value', 'k', 'lat']) AS x)""")
def cohort_correlation(spark, sf):
    return regression.cohort_correlation(tables.events(spark, sf), _members(spark, sf), ["value", "k", "lat"])


@query("cohort_components")
def cohort_components(spark, sf):
    """Principal components over the cohorts' samples: projected points."""
    points, _ = models.cohort_pca(tables.events(spark, sf), _members(spark, sf), ["value", "k", "lat", "lon"])
    return points


@query("cohort_component_loadings")
def cohort_component_loadings(spark, sf):
    return models.cohort_pca(tables.events(spark, sf), _members(spark, sf), ["value", "k", "lat", "lon"])[1]


@query("component_loadings_of_two", """
SELECT i AS component, col AS "column", round((1 + CASE i WHEN 1 THEN abs(r) ELSE -abs(r) END) / 2, 6) AS explained,
  round(sqrt(CAST(0.5 AS DOUBLE)), 6) AS loading
FROM (SELECT corr(value, k) AS r FROM ev JOIN mem USING (dataset_id) WHERE value IS NOT NULL AND k IS NOT NULL),
  (VALUES (1), (2)) c(i), (VALUES ('value'), ('k')) s(col)""")
def component_loadings_of_two(spark, sf):
    """Shares and sizes of the two components of two signals, over all rows of the cohorts: these have a closed form."""
    loadings = models.cohort_pca(tables.events(spark, sf), _members(spark, sf), ["value", "k"])[1]
    return rounded(loadings.select("component", "column", "explained", F.abs("loading").alias("loading")))


@query("recording_spectra", """
r AS (
  SELECT dataset_id, value, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY dataset_id) AS n,
    avg(value) OVER (PARTITION BY dataset_id) AS m, row_pos - lag(row_pos) OVER w AS dt
  FROM ev WHERE value IS NOT NULL WINDOW w AS (PARTITION BY dataset_id ORDER BY row_pos)),
rate AS (SELECT dataset_id, 1.0::DOUBLE / quantile_cont(dt::DOUBLE, 0.5) AS rate FROM r GROUP BY dataset_id),
x AS (SELECT dataset_id, i, n, value - m AS v, 0.5 - 0.5 * cos(2 * pi() * i / n) AS h FROM r WHERE n BETWEEN 32 AND 1024),
f AS (
  SELECT dataset_id, n, bin, sum(v * h * cos(2 * pi() * bin * i / n)) AS c, sum(v * h * sin(2 * pi() * bin * i / n)) AS s, sum(h * h) AS hh
  FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS bin FROM x) GROUP BY dataset_id, n, bin)
SELECT dataset_id, CAST(bin AS INTEGER) AS bin, round(bin * rate / n, 6) AS freq,
  round((c * c + s * s) / (rate * hh) * CASE WHEN bin = 0 OR 2 * bin = n THEN 1 ELSE 2 END, 2) AS density
FROM f JOIN rate USING (dataset_id)""")
def recording_spectra(spark, sf):
    """Power density of every recording of 32 rows and more, odd lengths too, with its own frequencies.

    Recordings above 1,024 rows average overlapping segments. The SQL has one segment and knows those of at most 1,024 rows.
    """
    rows = tables.events(spark, sf).withColumn("t", F.col("row_pos").cast("double"))
    found = spectrum.welch(rows, "value", "t")
    bins = found.select("dataset_id", "rate", "size", F.posexplode("density").alias("bin", "density"))
    return bins.select("dataset_id", "bin", F.round(F.col("bin") * F.col("rate") / F.col("size"), 6).alias("freq"),
                       F.round("density", 2).alias("density"))


@query("cohort_spectrum")
def cohort_spectrum(spark, sf):
    """Power spectra of the orders' totals along the order keys, two priority groups against the rest."""
    rows = tables.orders(spark, sf).withColumn("t", F.col("row_pos").cast("double"))
    ids = rows.select("dataset_id").distinct()
    urgent = F.col("dataset_id") < "3"
    members = ids.select(F.when(urgent, "urgent").otherwise("normal").alias("cohort"), "dataset_id")
    return spectrum.cohort_spectrum(rows, members, "o_totalprice", "t", band=(0.02, 0.05))


@query("cluster_labels")
def cluster_labels(spark, sf):
    """K-means labels of every line item."""
    rows = tables.table(spark, sf, "lineitem")
    return models.cluster_rows(rows, ["l_quantity", "l_extendedprice", "l_discount"], 4)


@query("cluster_profile", """
SELECT label AS cluster, count(*) AS "count", round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percent,
  round(avg(embedding[1]), 4) AS first, round(avg(embedding[2]), 4) AS second FROM embeddings GROUP BY label""")
def cluster_profile(spark, sf):
    rows = tables.table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"), F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(1)).alias("second"))
    return models.cluster_profile(rows, ["first", "second"])
