"""One query per operator over its whole driver table, with SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import line_dedup
from .decontaminate import contaminations
from .filter_audit import FILTERS, MAX_UPPER, MIN_DISTINCT, MIN_WORDS, ORDERS, SYMBOLS, audit_filters
from .imatch import fingerprints
from .language import identify_languages
from .masked_lm import score_texts
from .mixing import TARGETS, label_domains, mixing_rates
from .near_dedup import near_classes
from .quality import score_quality
from .shallot import CLUSTERS, COMPONENTS, ROUNDS, SCALE, cluster_vectors
from .tables import read
from .token_files import read_tokens, write_tokens
from .url_filter import DEFAULT_VERDICT, RULES, judge_urls
from .warc import page_digests, write_archives

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@query("op3_warc_segments", f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, strlen(payload) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}', 1 + CAST(
      (CAST('0x' || substr(hex, CAST(1 + (i // 4) * 5 AS INTEGER), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '')
      AS payload_digest,
    max(page_id) OVER (PARTITION BY payload) AS last_id
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last_id THEN NULL ELSE last_id END AS refers_to
FROM d""")
def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), folder)
    return page_digests(spark, folder)


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read(spark, sf_dir, "documents"))


@query("op7_line_dedup", f"""
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages),
common AS (
  SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(l.line) <> '' GROUP BY l.source, l.line, t.total
  HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > CAST({line_dedup.RATIO} AS DOUBLE) * t.total),
numbered AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line
  FROM documents),
marked AS (
  SELECT n.doc_id, n.i, n.line, c.line IS NOT NULL AS bad
  FROM numbered n LEFT JOIN common c ON n.source IS NOT DISTINCT FROM c.source AND n.line = c.line),
rebuilt AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE bad) AS INTEGER) AS dropped_lines,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT bad), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.dropped_lines, 0) AS dropped_lines, length(r.text) AS n_chars, md5(r.text) AS text_md5
FROM documents d LEFT JOIN rebuilt r USING (doc_id)""")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs, dropped="dropped_lines")
    return out.select("doc_id", "dropped_lines", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5"))


def _rule_sql() -> str:
    ranked = sorted(RULES, key=lambda r: -len(r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in ranked]
    names = " ".join(f"WHEN {fit} THEN '{r.name}'" for fit, r in zip(fits, ranked, strict=True))
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in ranked)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r AS (SELECT *, CASE {names} END AS rule FROM s)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdicts} END, '{DEFAULT_VERDICT}') AS verdict FROM r"""


@query("op8_url_filter", _rule_sql())
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op9_imatch")
def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_masked_lm")
def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"))


@query("op4_mixing")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(read(spark, sf_dir, "documents"), label_domains(read(spark, sf_dir, "labels")), TARGETS)


@query("op11_token_codes")
def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, folder)


def _cluster_sql() -> str:
    rounds = [f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {CLUSTERS})"""]
    for r in range(ROUNDS + 1):
        rounds.append(f"""
d{r} AS (
  SELECT k.vec_id, k.v, c.c, list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM kept k CROSS JOIN c{r} c),
a{r} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS best FROM d{r} GROUP BY vec_id, v)""")
        if r < ROUNDS:
            rounds.append(f"""
p{r} AS (SELECT best.c AS c, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM a{r}),
s{r} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p{r} GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),{",".join(rounds)}
SELECT a.vec_id, CAST(best.c AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.best.c = c.c"""


@query("op12_shallot", _cluster_sql())
def op12_shallot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))


_ORDER_SQL = ", ".join(f"('{o}')" for o in ORDERS)


@query("op13_filter_audit", f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[{SYMBOLS}]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier, filter_order[1:step] AS done
  FROM (VALUES {_ORDER_SQL}) o(filter_order), range(1, {len(FILTERS) + 1}) r(step)),
marked AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS bad, fails = own AS alone,
    fails <> '' AND regexp_matches(fails, '[' || done || ']') AS gone,
    earlier <> '' AND regexp_matches(fails, '[' || earlier || 'x]') AS before
  FROM cells CROSS JOIN steps),
sums AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (WHERE NOT gone), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (WHERE bad AND NOT before), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (WHERE bad AND before), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (WHERE bad AND NOT before), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (WHERE bad AND NOT before), 0) AS BIGINT) AS toxic_lost
  FROM marked GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
