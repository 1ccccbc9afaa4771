"""Tables of a folder, and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; unset, a temporary folder on one machine and an error on a
    cluster, whose executors would not find it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    where = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, dealt to all cores if it has fewer splits than those.

    A file of one row group is one task, however many cores wait. Only such small tables are moved; where
    there are splits enough the scan stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
