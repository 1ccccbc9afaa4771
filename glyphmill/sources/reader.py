"""Loading files as documents: paths -> bytes -> format -> blocks -> normalised -> rendered -> chunks.

Each file is one row. The size limit is a filter on the file listing, so an oversized file's bytes
are never read; a failure becomes a row with the reason, never a failed task.
"""

from __future__ import annotations

import glob
import os
import re
import time
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import errors as E
from .. import schema as S
from ..functions.slices import slices
from ..operators import chunk as C
from ..operators.normalize import normalize
from ..operators.render import render
from ..options import UNSET, Settings, resolve
from . import sniff
from .parsers import DEFAULT, Registry, check_zip_bomb

SLICE = 1 << 18
FILES = "path string, modificationTime timestamp, length long, content binary"


def expand(paths: Iterable[str | Path], spark: SparkSession | None = None) -> list[str]:
    """A folder gives its .docx files, an existing name is itself even if it looks like a pattern, else the
    pattern's matches in order; each file once. Names with a scheme are listed by Hadoop, which needs
    ``spark``; others are local."""
    out: dict[str, str] = {}
    for p in map(str, paths):
        if "://" in p:
            for f in _listed(p, spark):
                out.setdefault(f, f)
            continue
        found = sorted(str(f) for f in Path(p).rglob("*.docx") if f.is_file()) if os.path.isdir(p) else [p] if os.path.exists(p) else sorted(glob.glob(p, recursive=True)) or [p]
        for f in found:
            out.setdefault(os.path.realpath(f), f)
    return list(out.values())


def _listed(uri: str, spark: SparkSession | None) -> list[str]:
    if spark is None:
        raise ValueError(f"{uri} needs a session to be listed")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        if not fs.getFileStatus(path).isDirectory():
            return [uri]
        files, found = fs.listFiles(path, True), []
        while files.hasNext():
            name = files.next().getPath().toString()
            if name.endswith(".docx"):
                found.append(name)
        return sorted(found)
    return sorted(x.getPath().toString() for x in fs.globStatus(path) or ()) or [uri]


def exists(path: str, spark: SparkSession) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of ``FILES``; signs that Spark would take for a pattern are escaped."""
    escaped = ["".join("\\" + c if c in "[]{}*?\\" else c for c in p) for p in paths]
    return spark.read.format("binaryFile").load(escaped)


def parse_one(registry: Registry, ocr: bool | None, path: str, kind: str | None, hint: bool | None, content: bytes | None) -> dict:
    """A file's extraction, or its ``error_class`` and ``error``; no failure of an engine gets out."""
    if kind is None or content is None:
        return {}
    try:
        if kind in (S.DOCX, S.XLSX, S.PPTX):
            check_zip_bomb(content)
        chain = registry.chain(kind, hint if ocr is None else ocr)
        if not chain:
            raise E.EngineUnavailable(f"no engine for {kind}")
        failures = []
        for engine in chain:
            try:
                x = engine.parse(path, content)
            except E.MissingDependency:
                raise
            except Exception as e:
                failures.append(f"{type(e).__name__}: {e}")
                continue
            return {"text": x.text, "engine": x.engine, "page": x.page, "sheet": x.sheet, "fonts": x.fonts, "native_unicode": x.native_unicode, "warnings": x.warnings, "blocks": x.blocks}
        raise E.ExtractionError(f"all {len(failures)} engine(s) failed on {path}: {'; '.join(failures)}")
    except E.DocumentError as e:
        return {"error_class": type(e).__name__, "error": str(e)}


def _parse(registry: Registry, ocr: bool | None):
    kinds = pa.struct([("text", pa.string()), ("font", pa.string())])
    block = pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("fonts", pa.list_(pa.string())), ("runs", pa.list_(kinds))])
    types = {"text": pa.string(), "engine": pa.string(), "page": pa.int32(), "sheet": pa.string(), "fonts": pa.list_(pa.string()), "native_unicode": pa.bool_(), "warnings": pa.list_(pa.string()), "blocks": pa.list_(block), "error_class": pa.string(), "error": pa.string()}

    def parsed(source: pa.Array, kind: pa.Array, hint: pa.Array, content: pa.Array, *errors: pa.Array) -> pa.RecordBatch:
        rows, seconds = [], []
        for x in zip(*(c.to_pylist() for c in (source, kind, hint, content)), strict=True):
            began = time.perf_counter()
            rows.append(parse_one(registry, ocr, *x))
            seconds.append([("extract", time.perf_counter() - began)])
        found = [pa.array([r.get(n) for r in rows], t) for n, t in types.items() if n not in ("error_class", "error")]
        error = [pa.array([r.get(n) or old for r, old in zip(rows, olds.to_pylist(), strict=True)], pa.string()) for n, olds in zip(("error_class", "error"), errors, strict=True)]
        taken = pa.array(seconds, pa.map_(pa.string(), pa.float64()))
        return pa.RecordBatch.from_arrays([source, kind, *found, *error, taken], ["source", "content_type", *types, "layer_seconds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # what a container inflates to is several times its size, so slices are smaller than those of texts
            for part in slices(tuple(batch.column(c) for c in ("source", "content_type", "is_scanned_pdf", "content", "error_class", "error")), SLICE):
                yield parsed(*part)

    return run


def extract(files: DataFrame, max_bytes: int, ocr: bool | None = None, registry: Registry | None = None, at_hand: bool = False, timed: bool = False) -> DataFrame:
    """Rows of ``FILES`` to ``raw_extraction`` with error_class and error.

    Files over the limit are split off by a filter on the listing, so that their bytes are never read.
    Where the bytes are ``at_hand``, in a table or a step before, a column tells them apart instead, and the
    input is read once. ``timed`` adds the seconds each file took, as ``layer_seconds``.
    """
    plain, large = F.regexp_replace("path", "^file:(//)?(?=/)", ""), F.col("length") > max_bytes
    reason = F.concat("source", F.lit(" has "), "length", F.lit(f" bytes; the limit is {max_bytes}"))
    content = F.when(~large, F.col("content")).alias("content") if at_hand else F.col("content")
    sniffed = sniff.sniff((files if at_hand else files.where(~large)).select(plain.alias("path"), "length", content)).withColumnRenamed("path", "source")
    if at_hand:
        sniffed = sniffed.withColumns({"error_class": F.when(large, "UnsafeInput").otherwise(F.col("error_class")), "error": F.when(large, reason).otherwise(F.col("error"))})
    rows = sniffed.select("source", "content_type", "is_scanned_pdf", "content", "error_class", "error")
    out = rows.mapInArrow(_parse(registry or Registry(DEFAULT), ocr), S.RAW_EXTRACTION + ", error_class string, error string, layer_seconds map<string, double>")
    if not at_hand:
        refused = files.where(large).select(plain.alias("source"), "length").select("source", reason.alias("error"), F.lit("UnsafeInput").alias("error_class"))
        out = out.unionByName(refused, allowMissingColumns=True)
    return out if timed else out.drop("layer_seconds")


def documents(raw: DataFrame, settings: Settings, chunking: tuple[int, int] | None = None, prefix: str = "", strict: bool = False) -> DataFrame:
    """``raw_extraction`` with error columns to documents (text, metadata, chunks, error_class, error).

    A failed row has an empty text, or an empty payload of the asked format if ``prefix`` is given,
    and the reason as its warning. ``strict`` raises it instead.
    """
    if strict:
        raw = raw.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat("error_class", F.lit(": "), "error")).cast("boolean")).otherwise(True))
    df = normalize(raw, settings.encoding, settings.normalize)
    bad = F.col("error").isNotNull()
    none = F.lit(None)
    kind = F.when(bad & F.col("content_type").isNull(), S.UNKNOWN).otherwise(F.coalesce("content_type", F.lit(S.UNKNOWN)))
    df = df.withColumns({
        "content_type": F.when(bad & F.lit(bool(prefix)), S.UNKNOWN).otherwise(kind),
        "warnings": F.when(bad, F.array(F.concat(F.lit(prefix), "error"))).otherwise(F.col("warnings")),
        "encoding_confidence": F.when(bad, none.cast("double")).otherwise(F.col("encoding_confidence")),
        "text": F.when(bad, "").otherwise(F.col("text")),
    })
    df = C.chunk(df, *chunking) if chunking else df
    out = render(df, settings.output)
    return out if prefix else out.withColumn("text", F.when(bad, "").otherwise(F.col("text")))


def load(spark: SparkSession, path: str | Path, *, output=UNSET, encoding=UNSET, ocr=UNSET, normalize=UNSET, max_bytes=UNSET, chunk: tuple[int, int] | None = None, settings: Settings | None = None, registry: Registry | None = None, strict: bool = True, timed: bool = False) -> DataFrame:
    """One file as a one-row DataFrame of documents; a failure raises when the row is asked for.

    Without ``strict`` it is a row with the reason. A missing file raises whatever ``strict`` says.
    """
    s = resolve(settings, output=output, encoding=encoding, ocr=ocr, normalize=normalize, max_bytes=max_bytes)
    return documents(extract(read_files(spark, [str(path)]), s.max_bytes, s.ocr, registry, timed=timed), s, chunk, strict=strict)


def load_batch(spark: SparkSession, paths: Iterable[str | Path], *, output=UNSET, encoding=UNSET, ocr=UNSET, normalize=UNSET, max_bytes=UNSET, chunk: tuple[int, int] | None = None, settings: Settings | None = None, registry: Registry | None = None, timed: bool = False) -> DataFrame:
    """Many files as one DataFrame with ``seq``, the place in the input; sort by it where order counts.

    A file that fails, or that is not there, gives a document whose warning begins "failed to load".
    """
    s = resolve(settings, output=output, encoding=encoding, ocr=ocr, normalize=normalize, max_bytes=max_bytes)
    wanted = [str(p) for p in paths]
    there = {p: exists(p, spark) for p in dict.fromkeys(wanted)}
    full = {p: re.sub("^file:(//)?(?=/)", "", p) if "://" in p else os.path.abspath(p) for p in there}
    order = spark.createDataFrame([(i, p, full[p], there[p]) for i, p in enumerate(wanted)], "seq int, asked string, source string, there boolean")
    present = [full[p] for p, ok in there.items() if ok]
    raw = extract(read_files(spark, present) if present else spark.createDataFrame([], FILES), s.max_bytes, s.ocr, registry, timed=timed)
    absent = order.where(~F.col("there")).select("seq", F.col("asked").alias("source"), F.lit("OSError").alias("error_class"), F.concat(F.lit("no such file: "), "asked").alias("error"))
    found = order.where("there").join(raw, "source").withColumn("source", F.col("asked")).drop("asked", "there")
    return documents(found.unionByName(absent, allowMissingColumns=True), s, chunk, prefix="failed to load: ")
