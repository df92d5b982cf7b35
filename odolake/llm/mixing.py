"""Mixing documents to target weights by soft membership.

A naive Bayes classifier over hashed words, fitted on all labelled rows, gives each document's posterior over the domains. Document
rates r >= 0 then minimise the distance between the expected tokens of the domains, sum of r * tokens * posterior, and
their targets, by projected gradient steps. The step is scaled by the domains' Gram matrix, so a step solves the problem as
long as no rate is at zero. Every step is one aggregate of a few sums; a document's rate follows from those sums alone,
so only vectors as long as the list of domains reach the driver. Only expressions, joins and aggregates are used.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import lookup
from ..session import materialize
from .tables import column

BUCKETS = 4_096  # of hashed words
EVIDENCE = 200.0  # words that a text's evidence counts for at most, which keeps long texts' posteriors soft
STEPS = 60
TOLERANCE = 1e-7
_WORD_GAP = r"\s+|(?=[^\p{L}\p{N}\s])"  # words in their own case, and every mark by itself


def _words(rows: DataFrame) -> DataFrame:
    """A row per word of (doc_id, text), with a row of no word for a text without any; `first` is 1 once for each row."""
    keyed = rows.select("doc_id", F.xxhash64("text").alias("h"), F.split("text", _WORD_GAP).alias("words"))  # once a text, not once a word
    split = keyed.select("doc_id", "h", F.posexplode_outer("words").alias("at", "word"))
    return split.select(
        "doc_id", "h", F.when(F.coalesce("at", F.lit(0)) == 0, 1).otherwise(0).alias("first"),
        F.when(F.coalesce("word", F.lit("")) == "", 0).otherwise(1).alias("n"),
        F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def _evidence(labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """(bucket, e0, e1, ...): log P(word bucket | domain), one row per bucket; and the domains' log priors."""
    marks = labelled.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {r["domain"]: r["n"] for r in marks}
    total = sum(seen.values())
    priors = [float(np.log((seen.get(d, 0) + 1) / (total + len(domains)))) for d in domains]
    words = _words(labelled.select(F.struct("doc_id", "domain").alias("doc_id"), "text")).filter("n > 0")
    counts = materialize(words.groupBy("bucket").agg(
        *[F.sum(F.when(F.col("doc_id.domain") == d, 1).otherwise(0)).alias(f"c{k}") for k, d in enumerate(domains)]))
    sums = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(domains))]).first()
    every = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    return materialize(every.select("bucket", *[
        F.log((F.coalesce(f"c{k}", F.lit(0)) + 0.5) / (sums[f"c{k}"] + 0.5 * BUCKETS)).alias(f"e{k}") for k in range(len(domains))])), priors


def domain_posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, copies, tokens, p0, p1, ...) of every different row (doc_id, text): posteriors that sum to one.

    `labelled` has doc_id and domain. Rows of other domains or without an id teach nothing. A text without words has the priors.
    """
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    marks = labelled.select(column(labelled, "doc_id").alias("doc_id"), column(labelled, "domain").alias("domain")).filter(
        F.col("doc_id").isNotNull() & F.col("domain").isin(domains))
    evidence, priors = _evidence(lookup(rows, marks.distinct(), ["doc_id"]), domains)
    known = _words(rows).join(F.broadcast(evidence), "bucket", "left")  # one row per bucket
    ks = range(len(domains))
    sums = known.groupBy("doc_id", "h").agg(
        F.sum("first").alias("copies"), F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"e{k}")).alias(f"s{k}") for k in ks])
    weight = F.least(F.lit(1.0), F.lit(EVIDENCE) / F.col("tokens")) / F.col("copies")
    scored = sums.select("doc_id", "copies", (F.col("n") / F.col("copies")).cast("bigint").alias("tokens"), *[f"s{k}" for k in ks]).select(
        "doc_id", "copies", "tokens", *[(F.lit(priors[k]) + F.when(F.col("tokens") > 0, F.coalesce(f"s{k}", F.lit(0.0)) * weight).otherwise(0.0)).alias(f"l{k}") for k in ks])
    top = F.greatest(*[F.col(f"l{k}") for k in ks]) if len(domains) > 1 else F.col("l0")
    lifted = scored.select("doc_id", "copies", "tokens", *[F.exp(F.col(f"l{k}") - top).alias(f"x{k}") for k in ks])
    total = sum((F.col(f"x{k}") for k in ks), F.lit(0.0))
    return lifted.select("doc_id", "copies", "tokens", *[(F.col(f"x{k}") / total).alias(f"p{k}") for k in ks])


def _stepped(rate: Column, step: np.ndarray) -> Column:
    moved = rate
    for k, g in enumerate(step.tolist()):
        moved = moved - F.col(f"p{k}") * F.lit(g)
    return F.greatest(F.lit(0.0), moved)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float], budget: float | None = None,
                 steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, tokens, p_<domain>..., rate) of every row: the rate at which to draw it.

    `targets` has the wanted share of tokens of each domain; shares are scaled to sum to one. `budget` is the total of
    expected tokens, that of the input if not given. A rate of 2 draws a document twice. All rows start at rate 1 and stay in
    the result, rows that repeat too; null and empty texts have no tokens, the priors as posteriors, and a rate that follows from them.
    Null ids are kept. Without labels all posteriors are equal. Other columns are not read; an empty table gives an empty result.
    """
    domains = sorted(targets)
    if not domains or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must be shares of at least one domain, none below zero")
    ks = range(len(domains))
    state = materialize(domain_posteriors(docs, labelled, domains).withColumn("rate", F.lit(1.0)))
    mass = F.col("copies") * F.col("tokens")
    first = state.agg(F.sum(mass).alias("all"), *[F.sum(mass * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"g{i}_{j}") for i in ks for j in ks]).first()
    if first["all"]:
        gram = np.array([[first[f"g{i}_{j}"] for j in ks] for i in ks], dtype=float)
        scale = np.linalg.pinv(gram, rcond=1e-9)
        wanted = np.array([targets[d] for d in domains], dtype=float)
        wanted *= float(budget or first["all"]) / wanted.sum()
        rate, before = F.col("rate"), None
        for step in range(1, steps + 1):
            sums = state.agg(*[F.sum(mass * rate * F.col(f"p{k}")).alias(f"t{k}") for k in ks]).first()
            left = np.array([sums[f"t{k}"] for k in ks], dtype=float) - wanted
            if np.abs(left).max() <= tolerance * wanted.sum() or before is not None and np.abs(left - before).max() <= 0.01 * tolerance * wanted.sum():
                break
            before = left
            rate = _stepped(rate, scale @ left)
            if step % 10 == 0:  # keeps the expression short
                state = materialize(state.withColumn("rate", rate))
                rate = F.col("rate")
        state = state.withColumn("rate", rate)
    named = [F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)]
    repeated = state.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("doc_id", "tokens", *named, "rate")


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of the driver's labels: `toxic`, else `high` or `low` by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}
