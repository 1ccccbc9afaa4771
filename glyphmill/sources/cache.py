"""Results kept by content: a Parquet table keyed by a hash of bytes, path and options.

Misses are the left anti join with that table, hits the inner join, so a second run over the same
files parses nothing. Failures are not kept: what failed is tried again, as a missing library may have
been installed since.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..options import Settings
from ..schema import SCHEMA_VERSION
from . import reader


def cache_key(content: Column, path: Column, settings: Settings, chunking: tuple[int, int] | None = None) -> Column:
    """Covers what changes the result: bytes, path, version, format, encoding, OCR, form, chunking."""
    options = repr((SCHEMA_VERSION, settings.output, settings.encoding, settings.ocr, settings.normalize, chunking))
    return F.sha2(F.concat(content, F.encode(F.concat(F.lit("\0"), path, F.lit("\0" + options)), "UTF-8")), 256)


def misses(keyed: DataFrame, done: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among those of a result table."""
    return keyed.join(done.select("key"), "key", "left_anti")


def by_content(files: DataFrame, name: str = "path") -> DataFrame:
    """(hash, first, copies): each content once, with the least ``name`` that has it and the number of copies."""
    hashed = files.select(F.sha2("content", 256).alias("hash"), F.col(name).alias("first"))
    return hashed.groupBy("hash").agg(F.min("first").alias("first"), F.count("*").alias("copies"))


class ResultTable:
    """A folder of Parquet files with a ``key`` column; what cannot be read counts as empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path) or not fs.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path, "*.parquet")):
            return None
        return self.spark.read.option("ignoreCorruptFiles", "true").parquet(self.path)

    def load(self, files: DataFrame, settings: Settings, chunking: tuple[int, int] | None = None, registry=None) -> DataFrame:
        """Documents of the files with their ``key``; new ones are parsed and appended first."""
        path = F.regexp_replace("path", "^file:(//)?(?=/)", "")
        keyed = files.withColumn("key", cache_key(F.col("content"), path, settings, chunking))
        keys = keyed.select("key", path.alias("source"))
        old = self.read()
        new = keyed if old is None else misses(keyed, old)
        raw = reader.extract(new.drop("key"), settings.max_bytes, settings.ocr, registry)
        # read twice below: what succeeds is written, what fails is only given back
        parsed = reader.documents(raw, settings, chunking).join(keys, F.col("metadata.source") == F.col("source")).drop("source").persist()
        parsed.where("error is null").write.mode("append").parquet(self.path)
        failed, done = parsed.where("error is not null"), self.read()
        return failed if done is None else keys.select("key").join(done, "key").unionByName(failed)


def default_path(folder: str) -> str:
    return os.path.join(folder, "documents.cache")
