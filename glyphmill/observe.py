"""Measures of a run: counts beside it by ``df.observe``, and one record per document."""

from __future__ import annotations

import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

logger = logging.getLogger("glyphmill")


def observed(documents: DataFrame, name: str = "documents") -> tuple[DataFrame, Observation]:
    """The documents, and an observation with their number, failures, characters and encodings found."""
    seen = Observation(name)
    return documents.observe(seen, F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("metadata.encoding_detected").isNotNull()).alias("legacy")), seen


def metrics(documents: DataFrame) -> DataFrame:
    """One record per document: source, content_type, engine, encoding_detected, ok, layer_seconds, error.

    ``layer_seconds`` has the steps in Python, extract and normalize, of documents that were loaded ``timed``,
    else it is null; sniffing and rendering are expressions and take no time of their own.
    """
    seconds = F.col("layer_seconds") if "layer_seconds" in documents.columns else F.lit(None).cast("map<string, double>")
    fields = [F.col(f"metadata.{c}").alias(c) for c in ("source", "content_type", "engine", "encoding_detected")]
    return documents.select(*fields, F.col("error").isNull().alias("ok"), seconds.alias("layer_seconds"), F.concat_ws(": ", "error_class", "error").alias("error") if "error_class" in documents.columns else F.col("error"))


def emit(documents: DataFrame, hook: Callable[[dict[str, Any]], None]) -> int:
    """Call ``hook`` with each record, on the driver and partition by partition; the number of records.

    An error in the hook is logged and does not end the run. A run that fails gives a last record with
    ``ok`` false and the error before it raises.
    """

    def call(record: dict[str, Any]) -> None:
        try:
            hook(record)
        except Exception:
            logger.exception("the metrics hook raised")

    rows, n = metrics(documents), 0
    try:
        for row in rows.toLocalIterator():
            call(row.asDict(recursive=True) | {"error": row["error"] or None})
            n += 1
    except Exception as e:
        call(dict.fromkeys(rows.columns) | {"ok": False, "error": f"{type(e).__name__}: {e}"})
        raise
    return n
