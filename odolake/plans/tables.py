"""Driver tables seen as recordings, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_2024 = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user: signals value and k, state event_type, times ts and elapsed, a position per row."""
    raw = table(spark, sf_dir, "events")
    return raw.select(
        F.concat(F.lit("u"), F.col("user_id")).alias("dataset_id"), F.col("event_id").alias("row_pos"), "ts",
        ((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_2024 * 1_000_000) / 1e6).alias("elapsed"), "value",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"), "event_type",
        (35.0 + (F.col("event_id") % 1000) * 0.0001 + (F.col("user_id") % 40) * 0.05).alias("lat"),
        (139.0 + (F.col("event_id") % 700) * 0.0001 + (F.col("user_id") % 25) * 0.05).alias("lon"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per return flag and line status."""
    raw = table(spark, sf_dir, "lineitem")
    return raw.withColumn("dataset_id", F.concat("l_returnflag", "l_linestatus"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per supplier."""
    raw = table(spark, sf_dir, "lineitem")
    return raw.withColumn("dataset_id", F.concat(F.lit("s"), F.col("l_suppkey")))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per order priority: state o_orderstatus along the order keys."""
    raw = table(spark, sf_dir, "orders")
    return raw.select(F.col("o_orderpriority").alias("dataset_id"), F.col("o_orderkey").alias("row_pos"), "o_orderdate",
                      "o_orderstatus", "o_totalprice", "o_custkey")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of the users' recordings, with tags by user number."""
    raw = table(spark, sf_dir, "events")
    per = raw.groupBy("user_id").agg(F.count(F.lit(1)).alias("row_count"), F.max("ts").alias("created_at"))
    group = F.concat(F.lit("g"), F.col("user_id") % 3)
    tags = F.array_compact(F.array(group, F.when(F.col("user_id") % 2 == 0, F.lit("even"))))
    return per.select(F.concat(F.lit("u"), F.col("user_id")).alias("dataset_id"), "user_id", "row_count", "created_at",
                      tags.alias("tags"))


SPECS = [
    {"name": "A", "tags": ["g0"], "match": "all"},
    {"name": "B", "tags": ["g1", "even"], "match": "any"},
    {"name": "C", "tags": ["g2", "even"], "match": "all"},
]

GROUPS_SQL = """
  SELECT 'A' AS cohort, 0 AS position, user_id FROM cat WHERE user_id % 3 = 0
  UNION ALL SELECT 'B', 1, user_id FROM cat WHERE user_id % 3 = 1 OR user_id % 2 = 0
  UNION ALL SELECT 'C', 2, user_id FROM cat WHERE user_id % 3 = 2 AND user_id % 2 = 0"""

VIEWS = f"""
ev AS (
  SELECT 'u' || CAST(user_id AS VARCHAR) AS dataset_id, user_id, event_id AS row_pos, ts,
         (epoch_us(ts) - {EPOCH_2024}000000) / 1e6 AS elapsed, value,
         CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, event_type,
         CAST(35.0 AS DOUBLE) + (event_id % 1000) * CAST(0.0001 AS DOUBLE) + (user_id % 40) * CAST(0.05 AS DOUBLE) AS lat,
         CAST(139.0 AS DOUBLE) + (event_id % 700) * CAST(0.0001 AS DOUBLE) + (user_id % 25) * CAST(0.05 AS DOUBLE) AS lon
  FROM events),
li AS (SELECT l_returnflag || l_linestatus AS dataset_id, * FROM lineitem),
su AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS dataset_id, * FROM lineitem),
od AS (SELECT o_orderpriority AS dataset_id, o_orderkey AS row_pos, o_orderdate, o_orderstatus, o_totalprice, o_custkey
       FROM orders),
cat AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS dataset_id, user_id, count(*) AS row_count, max(ts) AS created_at,
               CASE WHEN user_id % 2 = 0 THEN ['g' || CAST(user_id % 3 AS VARCHAR), 'even']
                    ELSE ['g' || CAST(user_id % 3 AS VARCHAR)] END AS tags
        FROM events GROUP BY user_id),
mem AS (SELECT cohort, position, 'u' || CAST(user_id AS VARCHAR) AS dataset_id FROM ({GROUPS_SQL}))"""


def with_views(body: str) -> str:
    """SQL over the views; `body` is a query or further views followed by one ('x AS (...) SELECT ...')."""
    body = body.strip()
    if body.upper().startswith(("SELECT", "FROM")):
        return f"WITH {VIEWS.strip()}\n{body}"
    return f"WITH {VIEWS.strip()},\n{body}"
