"""Order-dependent operators that stay distributed when one recording holds most of the rows.

`Ordered` fixes an order of the rows of every key. When all keys are small it uses ordinary windows over
the key: one shuffle. When a key is larger than the bound, the rows are range-partitioned over (key, order),
so a large key is spread over many chunks; the chunk number is written down once (see `materialize`), each
operation runs a window inside (key, chunk), and a table with one row per (key, chunk) carries counts, sums
and last values from chunk to chunk. Both ways give the same rows.

The last order column must be unique within a key, which makes every result deterministic and lets the range
partitioner split equal order values.
"""

from __future__ import annotations

from collections.abc import Mapping
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import GROUP_ROWS_CONF, GROUP_ROWS_DEFAULT, conf_int
from ..session import materialize
from .frames import join_on, sort_last

CHUNK = "__chunk"
LOCAL = "__local"


def group_sizes(df: DataFrame, keys: Seq[str]) -> tuple[int, int]:
    """Rows of the largest key and of all keys: one key-only scan with map-side counts, two numbers to the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.max("n"), F.sum("n")).first()
    return row[0] or 0, row[1] or 0


def largest_group(df: DataFrame, keys: Seq[str]) -> int:
    return group_sizes(df, keys)[0]


class Ordered:
    def __init__(self, df: DataFrame, keys: Seq[str], order: Seq[str], *, split: bool | None = None):
        self.keys = list(keys)
        self.order = list(order)
        bound = conf_int(df.sparkSession, GROUP_ROWS_CONF, GROUP_ROWS_DEFAULT)
        largest, total = group_sizes(df, self.keys)
        self.split = largest > bound if split is None else split
        self._written = True
        if self.split:
            # chunks grow in number, not in size, with the data
            parts = max(2, conf_int(df.sparkSession, "spark.sql.shuffle.partitions", 200), -(-total // bound))
            ranged = df.repartitionByRange(
                parts, *[F.col(k).asc() for k in self.keys], *sort_last(*self.order))
            df = materialize(ranged.withColumn(CHUNK, F.spark_partition_id()))
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop(CHUNK) if self.split else self._df

    # -- building blocks -------------------------------------------------

    def _next(self, df: DataFrame) -> Ordered:
        out = object.__new__(Ordered)
        out.keys, out.order, out.split, out._df, out._written = self.keys, self.order, self.split, df, False
        return out

    def _window(self, backward: bool = False):
        parts = self.keys + ([CHUNK] if self.split else [])
        order = [F.col(c).desc_nulls_first() for c in self.order] if backward else sort_last(*self.order)
        return Window.partitionBy(*parts).orderBy(*order)

    def _source(self) -> DataFrame:
        """Input of a chunked step. It is read twice, so a derived one is written first."""
        return self._df if self._written else materialize(self._df)

    def _carry(self, df: DataFrame, edge: Mapping[str, Column], scan: Mapping[str, Column]) -> DataFrame:
        """Attach to each row values computed over the chunk table: `edge` per chunk, then `scan` over chunks."""
        at = self.keys + [CHUNK]
        edges = df.groupBy(*at).agg(*[c.alias(n) for n, c in edge.items()])
        carried = edges.select(*at, *[c.alias(n) for n, c in scan.items()])
        return join_on(df, carried, at, "left", null_keys=self.keys)

    def _chunks(self, backward: bool = False):
        return Window.partitionBy(*self.keys).orderBy(F.col(CHUNK).desc() if backward else F.col(CHUNK).asc())

    # -- operations ------------------------------------------------------

    def with_columns(self, columns: Mapping[str, Column]) -> Ordered:
        """Row-wise columns, computed in order."""
        df = self._df
        for name, column in columns.items():
            df = df.withColumn(name, column)
        return self._next(df)

    def row_number(self, name: str, total: str | None = None) -> Ordered:
        """1-based position inside the key and, if asked for, the number of rows of the key."""
        if not self.split:
            df = self._df.withColumn(name, F.row_number().over(self._window()).cast("long"))
            if total:
                df = df.withColumn(total, F.count(F.lit(1)).over(Window.partitionBy(*self.keys)))
            return self._next(df)
        df = self._source()
        scan = {"__before": F.coalesce(
            F.sum("__n").over(self._chunks().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
        if total:
            scan[total] = F.sum("__n").over(Window.partitionBy(*self.keys))
        df = self._carry(df, {"__n": F.count(F.lit(1))}, scan)
        df = df.withColumn(name, F.col("__before") + F.row_number().over(self._window()))
        return self._next(df.drop("__before"))

    def lag(self, columns: Mapping[str, str]) -> Ordered:
        """Values of the previous row of the key: {output name: column}. Null before the first row."""
        row = F.struct(*[F.col(c).alias(o) for o, c in columns.items()])
        w = self._window()
        if not self.split:
            df = self._df.withColumn("__prev", F.lag(row).over(w))
        else:
            df = self._source().withColumn("__row", row).withColumn(LOCAL, F.row_number().over(w))
            df = self._carry(df, {"__last": F.max_by("__row", LOCAL)},
                             {"__before": F.lag("__last").over(self._chunks())})
            df = df.withColumn("__prev", F.coalesce(F.lag("__row").over(w), F.col("__before")))
        df = df.select("*", *[F.col(f"__prev.{o}").alias(o) for o in columns])
        return self._next(df.drop("__prev", "__row", "__before", LOCAL))

    def running_sum(self, sums: Mapping[str, Column]) -> Ordered:
        """Sum from the first row of the key up to this row."""
        w = self._window().rowsBetween(Window.unboundedPreceding, 0)
        if not self.split:
            return self._next(self._df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()]))
        df = self._source()
        before = self._chunks().rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(df, {f"__s_{n}": F.sum(c) for n, c in sums.items()},
                         {f"__b_{n}": F.sum(f"__s_{n}").over(before) for n in sums})
        df = df.select("*", *[F.coalesce(F.col(f"__b_{n}") + F.sum(c).over(w), f"__b_{n}", F.sum(c).over(w)).alias(n)
                              for n, c in sums.items()])
        return self._next(df.drop(*[f"__b_{n}" for n in sums]))

    def last_known(self, values: Mapping[str, Column], inclusive: bool = True) -> Ordered:
        """Latest non-null value at or before this row (strictly before when not inclusive)."""
        return self._known(values, inclusive, backward=False)

    def next_known(self, values: Mapping[str, Column], inclusive: bool = True) -> Ordered:
        """Earliest non-null value at or after this row.

        Runs over the reversed order: a frame that ends at the last row would be summed anew for every row.
        """
        return self._known(values, inclusive, backward=True)

    def _known(self, values: Mapping[str, Column], inclusive: bool, backward: bool) -> Ordered:
        w = self._window(backward).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        near = {n: F.last(c, ignorenulls=True).over(w) for n, c in values.items()}
        if not self.split:
            return self._next(self._df.select("*", *[c.alias(n) for n, c in near.items()]))
        df = self._source().withColumn(LOCAL, F.row_number().over(self._window()))
        edge_by = F.min_by if backward else F.max_by
        edge = {f"__e_{n}": edge_by(c, F.when(c.isNotNull(), F.col(LOCAL))) for n, c in values.items()}
        over_chunks = self._chunks(backward).rowsBetween(Window.unboundedPreceding, -1)
        far = {f"__f_{n}": F.last(f"__e_{n}", ignorenulls=True).over(over_chunks) for n in values}
        df = self._carry(df, edge, far)
        df = df.select("*", *[F.coalesce(near[n], F.col(f"__f_{n}")).alias(n) for n in values])
        return self._next(df.drop(LOCAL, *far))

    def totals(self, aggregates: Mapping[str, Column]) -> Ordered:
        """Aggregates over all rows of the key, attached to each of them."""
        if not self.split:
            whole = Window.partitionBy(*self.keys)
            return self._next(self._df.select("*", *[c.over(whole).alias(n) for n, c in aggregates.items()]))
        df = self._source()
        per_key = df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggregates.items()])
        return self._next(join_on(df, per_key, self.keys, "left", null_keys=self.keys))
