"""Reading the driver tables, free column names, and batches of bounded size for the Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000  # texts of some KB each; Spark's own default of 10,000 is meant for narrow rows


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of at most BATCH_ROWS rows."""
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def column(df: DataFrame, name: str) -> Column:
    """Column by its exact name, also where the name has dots or other names differ in case only."""
    return df[f"`{name}`"]


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`; a null key is in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(0))


def delete(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table or folder, where it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
