"""CSV and Parquet scans that give every row its position in the file."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import SUPPORTED_EXTENSIONS
from ..limits import require
from ..operators.frames import lookup
from ..operators.ordered import Ordered


def extension(path: str) -> str:
    ext = PurePosixPath(path.rstrip("/")).suffix.lower()
    require(ext in SUPPORTED_EXTENSIONS, f"unsupported file type: {ext or path} (CSV and Parquet only)")
    return ext


def widen_integers(df: DataFrame) -> DataFrame:
    """Integral columns become BIGINT, so the same signal has one type in all recordings."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, small)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, *, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """One CSV recording, types inferred over all rows, with row_pos from 0."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, encoding=encoding, enforceSchema=False)
    placed = df.select("*", F.lit(0).alias("__all"), F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.file_block_start").alias("__block"),
                       F.monotonically_increasing_id().alias("__at"))
    out = Ordered(widen_integers(placed), ["__all"], ["__file", "__block", "__at"]).row_number("__rn").df
    return out.select((F.col("__rn") - 1).alias("row_pos"), *[F.col(f"`{c}`") for c in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One Parquet recording (a file, or a folder of parts in name order) with row_pos from 0."""
    df = spark.read.parquet(path)
    columns = df.columns
    placed = df.select("*", F.col("_metadata.row_index").alias("__i"), F.col("_metadata.file_path").alias("__file"))
    parts = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__file", F.coalesce(before, F.lit(0)).alias("__start"))  # one row per file
    out = lookup(placed, starts, ["__file"])
    return widen_integers(out.select((F.col("__i") + F.col("__start")).alias("row_pos"),
                                     *[F.col(f"`{c}`") for c in columns]))


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path) if extension(path) == ".csv" else read_parquet(spark, path)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """Type both sides can be read as: wider number, else text."""
    if a == b:
        return a
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        return T.LongType() if isinstance(a, whole) and isinstance(b, whole) else T.DoubleType()
    stamps = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, stamps) and isinstance(b, stamps):
        return T.TimestampNTZType()
    return T.StringType()


def union_by_name(frames: Seq[DataFrame]) -> DataFrame:
    """UNION ALL by column name: missing columns become null, differing types are widened."""
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            types[f.name] = common_type(types[f.name], f.dataType) if f.name in types else f.dataType
    out = None
    for df in frames:
        cast = df.select(*[F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name)
                           if f.dataType != types[f.name] else F.col(f"`{f.name}`") for f in df.schema.fields])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def stitch(parts: Seq[DataFrame], dataset_id: str = "stitched") -> DataFrame:
    """Concatenate recordings in the given order, columns by name, and number the rows anew."""
    require(len(parts) >= 2, "stitching needs at least two recordings")
    numbered = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    rows = union_by_name(numbered).withColumn("dataset_id", F.lit(dataset_id))
    # part sizes shift the positions: no sort, and each part stays where it is
    sizes = rows.groupBy("__part").agg(F.max("row_pos").alias("last"), F.min("row_pos").alias("first"),
                                       F.count(F.lit(1)).alias("n"))
    dense = sizes.filter((F.col("last") - F.col("first") + 1) != F.col("n")).limit(1).count() == 0
    if not dense:
        out = Ordered(rows, ["dataset_id"], ["__part", "row_pos"]).row_number("__rn").df
        return out.withColumn("row_pos", F.col("__rn") - 1).drop("__rn", "__part")
    w = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("__shift"))
    moved = rows.join(F.broadcast(starts), "__part")  # one row per part
    return moved.withColumn("row_pos", F.col("row_pos") + F.col("__shift")).drop("__part", "__shift")
