"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder where the session names none and runs on this machine alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path:
        if kept.isEmpty():
            spark.sparkContext.setCheckpointDir(path)
        return path.rstrip("/")
    if kept.isEmpty():
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='emberfold-')}")
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: what is made of them later has no plan before this."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path
