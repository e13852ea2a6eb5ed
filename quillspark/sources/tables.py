"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name`, one Parquet file or folder in `directory`."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The same rows in as many partitions as there are cores, where a scan of a few small files gives fewer; for work that is dear a row.
    Rows of larger tables, and of plans with an exchange, stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    query = rows._jdf.queryExecution()
    if "Exchange" in query.executedPlan().toString() or query.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
