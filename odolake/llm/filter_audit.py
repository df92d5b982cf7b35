"""How filters of a chain interact: contractions of the counts of documents by the filters that they fail.

Five filters give every document a cell of a 2x2x2x2x2 tensor (0 passes, 1 fails along each axis). Spark counts documents
per part and cell; whatever the order of the filters, what a step keeps, removes or loses is a contraction of that tensor
with a vector per axis that selects pass, fail or all. One einsum gives all steps of all orders for a batch of parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import lookup
from ..session import materialize
from .tables import column

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
CELLS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5  # words, and percentages of words and of code points
SYMBOLS = "#$%&*|"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
_COUNTS = ("docs", "good", "toxic")
_OUT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
        "good_lost bigint, toxic_lost bigint, shapley bigint")


def own_failures(text: Column) -> list[Column]:
    """Failures A to D, each judged by the text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.length(text)
    upper = chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < MIN_WORDS, 100 * distinct.cast("bigint") < MIN_DISTINCT * n.cast("bigint"),
            100 * upper.cast("bigint") > MAX_UPPER * chars.cast("bigint"), text.rlike(f"[{SYMBOLS}]")]


def failure_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cell, docs, good, toxic): documents by source and the filters they fail; bit 16 of `cell` is A and bit 1 is E.

    Null texts are empty and null sources are the part ''. E compares the SHA-256 of whole texts over the whole table: a row
    fails if the least id of its text is smaller than its own, so rows that repeat the least id pass, and null ids pass and
    never come before others. A document is good or toxic if any row of `labels` with its id says 1.
    """
    text = F.coalesce(column(docs, "text"), F.lit(""))
    own = own_failures(text)
    code = sum((F.when(fails, 1 << (len(FILTERS) - 1 - i)).otherwise(0) for i, fails in enumerate(own)), F.lit(0))
    facts = materialize(docs.select(
        column(docs, "doc_id").cast("bigint").alias("doc_id"), F.coalesce(column(docs, "source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), code.alias("code")))
    firsts = facts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1").drop("n")
    marks = labels.select(column(labels, "doc_id").cast("bigint").alias("doc_id"),
                          F.coalesce(column(labels, "quality") == 1, F.lit(False)).cast("int").alias("good"),
                          F.coalesce(column(labels, "toxic") == 1, F.lit(False)).cast("int").alias("toxic"))
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).filter("good + toxic > 0")
    judged = lookup(lookup(facts, firsts, ["digest"], "left"), marks, ["doc_id"], "left")
    again = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return judged.groupBy("part", (F.col("code") + again.cast("int")).alias("cell")).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def selectors() -> dict[str, np.ndarray]:
    """For each kind of count, the vectors by (axis, order and step, pass or fail)."""
    kinds = {"kept": (PASS, PASS, ALL), "removed": (PASS, FAIL, ALL), "failing": (ALL, FAIL, ALL), "unique_fails": (PASS, FAIL, PASS)}
    return {kind: np.array([[before if order.index(f) < step else own if order.index(f) == step else after
                             for order in ORDERS for step in range(len(FILTERS))] for f in FILTERS], dtype=np.int64)
            for kind, (before, own, after) in kinds.items()}


def contract(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of shape (parts, kinds of documents, orders times steps) from tensors (parts, kinds of documents, 2, 2, 2, 2, 2)."""
    return {kind: np.einsum("pzabcde,sa,sb,sc,sd,se->pzs", tensors, *vectors, optimize=True) for kind, vectors in selectors().items()}


def _step_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    axes, steps = len(FILTERS), len(FILTERS) * len(ORDERS)
    order = np.repeat(np.array(ORDERS, dtype=object), axes)
    step = np.tile(np.arange(1, axes + 1, dtype=np.int32), len(ORDERS))
    acting = np.array([o[s - 1] for o, s in zip(order, step, strict=True)])
    for batch in batches:
        for begin in range(0, len(batch), 100):
            some = batch.iloc[begin:begin + 100]
            tensors = np.zeros((len(some), len(_COUNTS), CELLS), dtype=np.int64)
            for p, cells in enumerate(some["cells"]):
                for c in cells:
                    tensors[p, :, c["cell"]] += [c[k] for k in _COUNTS]
            found = contract(tensors.reshape(len(some), len(_COUNTS), *[2] * axes))
            removed = found["removed"]
            shapley = np.zeros((len(some), steps), dtype=np.int64)
            for f in FILTERS:
                shapley[:, acting == f] = removed[:, 0, acting == f].sum(axis=1, keepdims=True)
            yield pd.DataFrame({
                "part": np.repeat(some["part"].to_numpy(object), steps), "filter_order": np.tile(order, len(some)), "step": np.tile(step, len(some)),
                "kept": found["kept"][:, 0].ravel(), "removed": removed[:, 0].ravel(), "redundant": (found["failing"] - removed)[:, 0].ravel(),
                "unique_fails": found["unique_fails"][:, 0].ravel(), "good_lost": removed[:, 1].ravel(), "toxic_lost": removed[:, 2].ravel(),
                "shapley": shapley.ravel()})


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step, with what the step keeps, removes and loses; see `failure_cells`.

    Columns: part, filter_order, step, kept, removed, redundant (failing the filter, removed before), unique_fails, good_lost,
    toxic_lost and shapley (removed by the filter, summed over all orders). An empty table has no parts, so no rows.
    """
    cells = failure_cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", *_COUNTS)).alias("cells"))  # at most CELLS a part
    return cells.mapInPandas(_step_rows, _OUT)
