"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_own_dir: list[str] = []
_written: list[str] = []


def build_session(app: str = "odolake", master: str | None = None, partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach. A folder of this machine is used only where the cluster names none."""
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="odolake-"))
    return _own_dir[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a parquet table in the shared folder and read it back.

    Cuts the lineage, fixes values that would differ between two evaluations (range bounds) and
    survives lost executors, since the table does not live on them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/odolake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_tables(spark: SparkSession) -> int:
    """Delete the tables `materialize` wrote in this process, once the results that read them are done with."""
    for path in _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    count = len(_written)
    _written.clear()
    return count
