"""Format detection by magic bytes, as expressions over a BINARY column."""

from __future__ import annotations

import io
import zipfile
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import schema as S
from ..functions.slices import in_slices

WINDOW = 8 + 65536
ENTRIES = (("word/document.xml", S.DOCX), ("xl/workbook.xml", S.XLSX), ("ppt/presentation.xml", S.PPTX))


def _begins(content: Column, magic: bytes) -> Column:
    return F.startswith(content, F.unhex(F.lit(magic.hex())))


def classify_zip(content: bytes) -> str | None:
    """The OOXML type of a ZIP container by its entries, ``corrupt`` or None for another one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
    except (zipfile.BadZipFile, NotImplementedError, EOFError, ValueError):
        return "corrupt"
    return next((kind for entry, kind in ENTRIES if entry in names), None)


@lru_cache(maxsize=1)
def _zip_udf():
    return in_slices(lambda v: pa.array([None if x is None else classify_zip(x) for x in v.to_pylist()], pa.string()), StringType(), pa.string())


def family(content: Column) -> Column:
    """The type by the first bytes alone; ``zip`` for any ZIP container, NULL if unknown."""
    rtf = b"{\\rtf"
    return (
        F.when(_begins(content, b"%PDF-"), S.PDF)
        .when(_begins(content, bytes.fromhex("D0CF11E0A1B11AE1")), S.OLE2)
        .when(_begins(content, rtf) | _begins(content, b"\xef\xbb\xbf" + rtf), S.RTF)
        .when(_begins(content, b"PK\x03\x04"), "zip")
    )


def scanned_hint(content: Column) -> Column:
    """False where a PDF's first bytes name a font, else NULL; never true."""
    head = F.substring(content, 1, WINDOW)
    return F.when(_begins(content, b"%PDF-") & F.contains(head, F.unhex(F.lit(b"/Font".hex()))), F.lit(False))


def sniff(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds content_type, is_scanned_pdf, error_class and error to rows with bytes."""
    data, kind = F.col(content), F.col("_family")
    df = files.withColumn("_family", family(data))
    df = df.withColumn("_zip", _zip_udf()(F.when(kind == "zip", data)))
    found = F.when(kind == "zip", F.when(F.col("_zip") != "corrupt", F.col("_zip"))).otherwise(kind)
    path = F.col("path") if "path" in files.columns else F.lit("")
    reason = (
        F.when(found.isNotNull(), None)
        .when(F.col("_zip") == "corrupt", F.concat(F.lit("corrupt ZIP container: "), path))
        .when(kind == "zip", F.concat(F.lit("ZIP container is of no known document type: "), path))
        .otherwise(F.concat(F.lit("unknown format: "), path, F.lit(" (first bytes "), F.hex(F.substring(data, 1, 4)), F.lit(")")))
    )
    df = df.withColumns({"content_type": found, "is_scanned_pdf": scanned_hint(data), "error_class": F.when(found.isNull(), "UnsupportedFormat"), "error": reason})
    return df.drop("_family", "_zip")
