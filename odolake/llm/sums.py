"""Element-wise sums of arrays that the partitions of a table give."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, values in zip(batch["i"], batch["sums"], strict=True):
            totals[i] = totals[i] + values if i in totals else np.array(values, dtype=float)
    if totals:
        yield pd.DataFrame({"i": np.array(list(totals), dtype=np.int32), "sums": list(totals.values())})


def add_up(parts: DataFrame) -> DataFrame:
    """(i, sums) with the arrays of equal `i` added. Reducers add as they read, so they hold one array per `i`."""
    return parts.repartition("i").mapInPandas(_add, "i int, sums array<double>")
