"""Section-aware chunking with overlap.

Units (headings, paragraphs, table rows) are made by expressions. Where chunks begin and end depends
on where the one before ended, so the ranges are found by one linear walk over the units' token
counts in an Arrow function, which sees numbers and section labels only; the texts stay in the JVM.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.text import estimate_tokens, trim_ws
from .render import blocks_of

MAX_TOKENS = 512
OVERLAP = 64

_UNITS = "array<struct<text string, block int, head boolean>>"


def units(blocks: Column) -> Column:
    """ARRAY<STRUCT<text, block, head>>: the atomic pieces of a block array.

    Empty paragraphs and headings and rows of blank cells are none.
    """

    def one(block: Column, i: Column) -> Column:
        rows = F.filter(block["rows"], lambda row: F.exists(row, lambda c: trim_ws(c) != ""))
        lines = F.transform(rows, lambda r: F.struct(F.array_join(r, "\t", "").alias("text"), i.cast("int").alias("block"), F.lit(False).alias("head")))
        text = F.array(F.struct(block["text"].alias("text"), i.cast("int").alias("block"), (block["type"] == "heading").alias("head")))
        return F.when(block["type"] == "table", lines).when(block["text"] != "", text).otherwise(F.expr(f"cast(array() as {_UNITS})"))

    return F.flatten(F.transform(blocks, lambda b, i: F.coalesce(one(b, i), F.expr(f"cast(array() as {_UNITS})"))))


def ranges(tokens: list[int], sections: list[str], heads: list[bool], most: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks as (first unit, unit after the last)."""
    out: list[tuple[int, int]] = []
    start, n = 0, len(tokens)
    while n:
        end, size = start, 0
        while end < n and (end == start or not (heads[end] or sections[end] != sections[start]) and size + tokens[end] <= most):
            size += tokens[end]
            end += 1
        out.append((start, end))
        if end == n:
            break
        if not (heads[end] or sections[end] != sections[start]):
            back, size = end, 0
            while back > start + 1 and size < overlap:
                back -= 1
                size += tokens[back]
            start = back
        else:
            start = end
    return out


_RANGE = ArrayType(StructType().add("start", IntegerType()).add("stop", IntegerType()).add("section", StringType()))


@lru_cache(maxsize=None)
def _walk(most: int, overlap: int):
    def run(tokens: pa.Array, block: pa.Array, head: pa.Array, at: pa.Array, label: pa.Array) -> pa.Array:
        out = []
        for t, b, h, p, names in zip(*(x.to_pylist() for x in (tokens, block, head, at, label)), strict=True):
            if not t:
                out.append([])
                continue
            section = ["" if (k := bisect_right(p, i)) == 0 else names[k - 1] or "" for i in b]
            out.append([{"start": i, "stop": j, "section": section[i]} for i, j in ranges(t, section, h, most, overlap)])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("section", pa.string())]))
        return pa.array(out, kind)

    # not deterministic in name only: else a filter inferred from exploding the chunks would copy the
    # call into a higher-order function, where Python cannot be evaluated
    return F.arrow_udf(run, _RANGE).asNondeterministic()


def chunk(doc: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Adds ``chunks`` to normalised documents: ARRAY<STRUCT<text, metadata, index>>.

    A chunk never crosses a section and never splits a unit; one that is over the target stays
    whole. Consecutive chunks of a section share about ``overlap`` tokens.
    """
    df = doc.withColumn("_blocks", blocks_of(F.col("blocks"), F.coalesce("text", F.lit("")))).withColumn("_units", units(F.col("_blocks")))
    places = F.filter(F.transform("_blocks", lambda b, i: F.when(b["type"] == "heading", i.cast("int"))), lambda i: i.isNotNull())
    labels = F.transform(F.filter("_blocks", lambda b: b["type"] == "heading"), lambda b: F.coalesce(b["text"], F.lit("")))
    tokens = F.transform("_units", lambda u: estimate_tokens(u["text"]))
    df = df.withColumn("_ranges", _walk(max_tokens, overlap)(tokens, F.col("_units.block"), F.col("_units.head"), places, labels))
    made = F.transform(
        "_ranges",
        lambda r, i: F.struct(
            F.array_join(F.transform(F.slice("_units", r["start"] + 1, r["stop"] - r["start"]), lambda u: u["text"]), "\n").alias("text"),
            F.struct(r["section"].alias("section"), F.col("page").cast("int").alias("page"), F.col("sheet").cast("string").alias("sheet")).alias("metadata"),
            i.cast("int").alias("index"),
        ),
    )
    return df.withColumn("chunks", made).drop("_blocks", "_units", "_ranges")
