"""Documents as (text, metadata) records for retrieval frameworks."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MissingDependency

_SCALAR = ("source", "content_type", "page", "sheet", "lang", "encoding_detected", "encoding_confidence", "engine")


def records(documents: DataFrame) -> DataFrame:
    """One row per chunk, or one for a document without chunks; the chunk's page and sheet win.

    Columns: text, the metadata fields, section, warnings (NULL if none), extra, chunk_index.
    """
    keys = [c for c in documents.columns if c not in ("text", "metadata", "chunks")]
    rows = documents.select(*keys, F.col("text").alias("_text"), "metadata", F.posexplode_outer("chunks").alias("_pos", "_chunk"))
    whole = F.col("_chunk").isNull()
    columns = [F.when(whole, F.col(f"metadata.{c}")).otherwise(F.col(f"_chunk.metadata.{c}")).alias(c) if c in ("page", "sheet") else F.col(f"metadata.{c}").alias(c) for c in _SCALAR]
    warnings = F.when(F.size("metadata.warnings") > 0, F.col("metadata.warnings")).alias("warnings")
    return rows.select(*keys, F.when(whole, F.col("_text")).otherwise(F.col("_chunk.text")).alias("text"), *columns, F.col("_chunk.metadata.section").alias("section"), warnings, F.col("metadata.extra").alias("extra"), F.col("_chunk.index").alias("chunk_index"))


def as_dicts(documents: DataFrame) -> Iterator[tuple[str, dict[str, Any]]]:
    """The records on the driver, partition by partition."""
    for row in records(documents).toLocalIterator():
        data = row.asDict(recursive=True)
        metadata = {c: data[c] for c in _SCALAR}
        if data["warnings"]:
            metadata["warnings"] = data["warnings"]
        metadata |= data["extra"] or {}
        if data["chunk_index"] is not None:
            metadata |= {"section": data["section"], "chunk_index": data["chunk_index"]}
        yield data["text"], metadata


def _wrapped(documents: DataFrame, module: str, build) -> Iterator[Any]:
    try:
        target = import_module(module)
    except ImportError as e:
        raise MissingDependency(f"{module} is not installed") from e
    return (build(target, text, metadata) for text, metadata in as_dicts(documents))


def to_langchain(documents: DataFrame) -> Iterator[Any]:
    return _wrapped(documents, "langchain_core.documents", lambda m, t, d: m.Document(page_content=t, metadata=d))


def to_llamaindex(documents: DataFrame) -> Iterator[Any]:
    return _wrapped(documents, "llama_index.core", lambda m, t, d: m.Document(text=t, metadata=d))
