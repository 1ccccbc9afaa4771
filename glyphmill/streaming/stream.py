"""The same stages on a stream of files or texts.

The core keeps no state, so its transforms run unchanged. Only dropping repeated contents does; it
is bounded by a watermark on the file time. A file that comes later than that may be parsed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, estimate_tokens
from ..options import Settings
from ..sources import reader


def read_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(reader.FILES).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def once_by_content(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Files whose bytes were not seen within the delay."""
    hashed = files.withColumn("hash", F.sha2("content", 256)).withWatermark("modificationTime", delay)
    return hashed.dropDuplicatesWithinWatermark(["hash"]).drop("hash")


def documents(files: DataFrame, settings: Settings | None = None, chunking: tuple[int, int] | None = None) -> DataFrame:
    s = settings or Settings()
    return reader.documents(reader.extract(files, s.max_bytes, s.ocr), s, chunking)


def clean_stream(texts: DataFrame) -> DataFrame:
    """Rows with a text column, cleaned and counted."""
    return texts.withColumn("text", clean_text(F.col("text"))).withColumn("tokens", estimate_tokens(F.col("text")))
