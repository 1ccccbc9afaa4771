"""Rendering of normalised documents as text, Markdown or versioned JSON."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import BLOCK, METADATA_FIELDS, SCHEMA_VERSION

FORMATS = ("text", "markdown", "json")


def blocks_of(blocks: Column, text: Column) -> Column:
    """A document's blocks; one without any is a paragraph of its text, or nothing if that is empty."""
    lone = F.array(F.struct(F.lit("paragraph").alias("type"), F.lit(None).cast("int").alias("level"), text.alias("text"), F.lit(None).cast("array<array<string>>").alias("rows")))
    return F.when(F.size(blocks) > 0, blocks).when(text != "", lone).otherwise(F.expr(f"cast(array() as array<{BLOCK}>)"))


def clamp(level: Column) -> Column:
    return F.least(F.greatest(F.coalesce(level, F.lit(1)), F.lit(1)), F.lit(6))


def escape_cell(cell: Column) -> Column:
    for old, new in (("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>")):
        cell = F.replace(cell, F.lit(old), F.lit(new))
    return cell


def table_markdown(rows: Column) -> Column:
    """A pipe table, short rows padded, the first row its head; null for a table without rows."""
    width = F.array_max(F.transform(rows, F.size))

    def line(row: Column) -> Column:
        cells = F.concat(row, F.array_repeat(F.lit(""), width - F.size(row)))
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape_cell(F.coalesce(c, F.lit("")))), " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))))
    return F.when(F.size(rows) > 0, F.array_join(whole, "\n"))


def block_markdown(block: Column) -> Column:
    heading = F.concat(F.repeat(F.lit("#"), clamp(block["level"])), F.lit(" "), block["text"])
    return F.when(block["type"] == "heading", heading).when(block["type"] == "table", table_markdown(block["rows"])).otherwise(block["text"])


def to_markdown(blocks: Column, text: Column) -> Column:
    parts = F.transform(blocks_of(blocks, text), block_markdown)
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")


def block_json(block: Column) -> Column:
    """A block as compact JSON with the keys of its type only."""
    kept = {"ignoreNullFields": "false"}
    heading = F.to_json(F.struct(block["type"].alias("type"), clamp(block["level"]).alias("level"), block["text"].alias("text")), kept)
    table = F.to_json(F.struct(block["type"].alias("type"), block["rows"].alias("rows")), kept)
    return F.when(block["type"] == "heading", heading).when(block["type"] == "table", table).otherwise(F.to_json(F.struct(F.lit("paragraph").alias("type"), block["text"].alias("text")), kept))


def to_json_compact(doc: DataFrame, text: Column) -> Column:
    """The versioned payload in one line: version, provenance with nulls kept, blocks."""
    head = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *[F.col(c) for c in METADATA_FIELDS if c in doc.columns]), {"ignoreNullFields": "false"})
    blocks = F.array_join(F.transform(blocks_of(F.col("blocks"), text), block_json), ",")
    return F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"blocks":['), blocks, F.lit("]}"))


@lru_cache(maxsize=1)
def _indent():
    return F.arrow_udf(lambda v: pa.array([None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2) for x in v.to_pylist()], pa.string()), StringType())


def to_json(doc: DataFrame, text: Column) -> Column:
    """The payload indented by two, which Spark cannot print itself."""
    return _indent()(to_json_compact(doc, text))


def render(doc: DataFrame, output: str = "markdown") -> DataFrame:
    """``normalized_doc`` to ``document``: text in the asked format, metadata, no chunks yet.

    Columns that are none of the document's go along.
    """
    if output not in FORMATS:
        raise ValueError(f"output must be one of {list(FORMATS)}, got {output!r}")
    text = F.coalesce(F.col("text"), F.lit(""))
    shown = text if output == "text" else to_markdown(F.col("blocks"), text) if output == "markdown" else to_json(doc, text)
    metadata = F.struct(*[F.col(c) for c in METADATA_FIELDS], F.expr("cast(map() as map<string,string>)").alias("extra"))
    rest = [F.col(f"`{c}`") for c in doc.columns if c not in (*METADATA_FIELDS, "text", "blocks", "chunks")]
    chunks = [F.col("chunks")] if "chunks" in doc.columns else [F.expr("cast(array() as array<struct<text string, metadata struct<section string, page int, sheet string>, index int>>)").alias("chunks")]
    return doc.select(*rest, shown.alias("text"), metadata.alias("metadata"), *chunks)
