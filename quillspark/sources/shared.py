"""The shared folder in which long plans put what they cut their lineage at."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder below spark.checkpoint.dir.

    Where the setting is missing, a session on one machine gets a temporary folder that is set there; on a cluster, where every
    executor would write to its own disk, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quillspark-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """The folder, which is there by now, goes when the driver's JVM ends."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)


def written(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends, and a lost executor costs nothing.

    The files go when the driver's JVM ends.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
