"""Normalisation of extracted documents: detect, convert, clean, NFC.

Where a document's fonts disagree, each block, or each run of a block, is converted by its own
verdict; a document that agrees is converted whole, its flat text staying the extractor's own.

The normal form has to be made in Python, so all of a document is done in that one crossing: an
Arrow function takes the blocks and the flat text of a batch and gives them back normalised. As
expressions the same rules are a tree of some hundred regexes, since each branch repeats them.
"""

from __future__ import annotations

import time
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from ..functions import charmaps
from ..functions.plain import Verdict, clean, convert, detect_content, detect_fonts, dominant, font_encoding, normal, tidy
from ..functions.slices import by_slices, values
from ..functions.text import FORMS
from ..schema import BLOCK_TYPE

LOW = 0.75
OVERRIDE = 1.0
FROM_FONT, FROM_PLAIN_FONT = 0.95, 0.9

Segment = tuple[str | None, float, bool]  # encoding, confidence, and whether it is the segment's own


def plan(block: dict, doc: Verdict) -> tuple[list[Segment], bool, bool]:
    """A block's segments, whether they are its runs, and whether its own fonts disagree."""
    runs = block["runs"]
    if runs and "".join(r["text"] or "" for r in runs) == (block["text"] or ""):
        out: list[Segment] = []
        for r in runs:
            found = font_encoding(r["font"])
            out.append((found, FROM_FONT if found else FROM_PLAIN_FONT, True) if r["font"] else (doc.encoding, doc.confidence, False))
        return out, True, False
    if block["fonts"] is None:
        return [(doc.encoding, doc.confidence, False)], False, False
    own = detect_fonts(block["fonts"])
    return [(own.encoding, own.confidence, True)], False, own.method == "font-signal-mixed"


def joined(runs: list[dict], segments: list[Segment]) -> str:
    """The runs converted, neighbours of one encoding together, since a letter may span two."""
    together = groupby(zip(runs, segments, strict=True), key=lambda x: x[1][0])
    return "".join(convert("".join(r["text"] or "" for r, _ in part), encoding) for encoding, part in together)


def typed(block: dict, change, text: str | None = None) -> dict:
    """A raw block as a typed one; what is missing or unknown becomes a paragraph, level 1, no text."""
    kind = block["type"] if block["type"] in ("table", "heading") else "paragraph"
    if kind == "table":
        return {"type": kind, "level": None, "text": None, "rows": [[change(c or "") for c in row or ()] for row in block["rows"] or ()]}
    return {"type": kind, "level": (block["level"] or 1) if kind == "heading" else None, "text": change(block["text"] or "") if text is None else text, "rows": None}


def flat_text(blocks: list[dict]) -> str:
    """The blocks' lines; a table has its rows, cells joined by tabs."""
    return "\n".join(line for b in blocks for line in (["\t".join(r) for r in b["rows"]] if b["type"] == "table" else [b["text"]]))


def normalized(blocks: list[dict] | None, text: str | None, fonts: list[str | None] | None, native: bool | None, encoding: str | None, form: str) -> dict:
    """One document: its text, encoding and confidence, the notes to add, and its blocks."""
    blocks, text, notes = blocks or [], text or "", []
    forced = encoding if encoding and encoding != "auto" else None
    if forced:
        doc = Verdict(forced, OVERRIDE, "override")
    elif native:
        doc = Verdict(None, OVERRIDE, "native")
    else:
        doc = detect_fonts(fonts or [])
        if encoding == "auto" and doc.method == "assumed-unicode":
            doc = detect_content(normal(clean(normal(text, form) if form in ("NFKC", "NFKD") else text), form))
    found, confidence, mixed = doc.encoding, doc.confidence, False

    if forced:
        if forced not in charmaps.CHARMAPS:
            notes.append(f"no conversion table for encoding '{forced}'; text left unconverted")
    else:
        plans = [plan(b, doc) for b in blocks]
        segments = [s for own, _, _ in plans for s in own]
        signals = any(b["fonts"] is not None or b["runs"] is not None for b in blocks)
        mixed = not native and signals and len({s[0] for s in segments}) > 1
        if mixed:
            found = dominant(dominant(s[0] for s in own) for own, _, _ in plans)
            confidence = min((s[1] for s in segments if s[2] and s[0] == found), default=doc.confidence) if found else doc.confidence
            if len({s[0] for s in segments} - {None}) > 1 or any(p[2] for p in plans):
                notes.append("multiple legacy encodings across blocks; converted per block")
        elif doc.method == "font-signal-mixed":
            notes.append(f"multiple legacy encodings detected; converting all as '{doc.encoding}'")

    # a document's flat text is often that of its only block: each text is changed once
    known: dict[tuple[str, str | None], str] = {}
    final: dict[str, str] = {}

    def changed(t: str, by: str | None) -> str:
        if (t, by) not in known:
            known[t, by] = clean(convert(t, by))
        return known[t, by]

    def last(t: str) -> str:
        if t not in final:
            new = normal(t, form)
            final[t] = normal(clean(new), form) if form in ("NFKC", "NFKD") else new  # these make new spaces
        return final[t]

    if mixed:
        out = []
        for b, (own, by_run, _) in zip(blocks, plans, strict=True):
            torn = by_run and len({s[0] for s in own}) > 1
            out.append(typed(b, lambda t, e=own[0][0]: changed(t, e), clean(joined(b["runs"], own)) if torn else None))
        flat = tidy(flat_text(out))
    else:
        out = [typed(b, lambda t: changed(t, doc.encoding)) for b in blocks]
        flat = changed(text, doc.encoding)

    if confidence < LOW:
        notes.append(f"low encoding-detection confidence ({confidence:.2f})")
    return {"text": last(flat), "encoding": found, "confidence": confidence, "notes": notes, "blocks": [typed(b | {"runs": None}, last) for b in out]}


_RESULT = StructType().add("seconds", DoubleType()).add("text", StringType()).add("encoding", StringType()).add("confidence", DoubleType()).add("notes", ArrayType(StringType())).add("blocks", ArrayType(BLOCK_TYPE))
_BLOCKS = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))]))
_ARROW = pa.struct([("seconds", pa.float64()), ("text", pa.string()), ("encoding", pa.string()), ("confidence", pa.float64()), ("notes", pa.list_(pa.string())), ("blocks", _BLOCKS)])


@lru_cache(maxsize=None)
def _pass(encoding: str | None, form: str):
    if form not in FORMS:
        raise ValueError(f"form must be one of {list(FORMS)}, got {form!r}")

    def run(blocks: pa.Array, text: pa.Array, fonts: pa.Array, native: pa.Array) -> pa.Array:
        out = []
        for row in zip(*map(values, (blocks, text, fonts, native)), strict=True):
            began = time.perf_counter()
            found = normalized(*row, encoding, form)
            out.append(found | {"seconds": time.perf_counter() - began})
        return pa.array(out, _ARROW)

    # not deterministic in name only: else the optimizer could call it once for each field
    return by_slices(run, _RESULT).asNondeterministic()


def normalize(raw: DataFrame, encoding: str | None = None, form: str = "NFC") -> DataFrame:
    """Rows of ``raw_extraction`` to rows of ``normalized_doc``; other columns go along.

    ``encoding`` forces a charmap; ``"auto"`` allows detection by content where no font tells
    anything, which is off by default, as it can take other Latin text for legacy Vietnamese.
    ``layer_seconds``, if there is such a column, gets the seconds of this step too.
    """
    df = raw.withColumn("_n", _pass(encoding, form)("blocks", "text", "fonts", "native_unicode"))
    n, none = F.col("_n"), F.expr("cast(array() as array<string>)")
    columns = {
        "text": n["text"],
        "lang": F.lit(None).cast("string"),
        "encoding_detected": n["encoding"],
        "encoding_confidence": n["confidence"],
        "warnings": F.concat(F.coalesce("warnings", none), n["notes"]),
        "blocks": n["blocks"],
    }
    if "layer_seconds" in raw.columns:
        columns["layer_seconds"] = F.map_concat(F.coalesce("layer_seconds", F.expr("cast(map() as map<string, double>)")), F.create_map(F.lit("normalize"), n["seconds"]))
    kept = [F.col(f"`{c}`") for c in raw.columns if c not in (*columns, "fonts", "native_unicode")]
    return df.select(*kept, *[c.alias(name) for name, c in columns.items()])


@lru_cache(maxsize=1)
def _dominant():
    return F.arrow_udf(lambda values: pa.array([None if v is None else dominant(v) for v in values.to_pylist()], pa.string()), StringType())


def dominant_encoding(encodings: Column) -> Column:
    """The most frequent non-null value of an array of encodings; of equals the first."""
    return _dominant()(encodings)
