"""Row types of the stages. All arrays are ordered; NULL stands for an absent key."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, StringType, StructType

SCHEMA_VERSION = "1.0"

RAW_BLOCK = "struct<type string, level int, text string, rows array<array<string>>, fonts array<string>, runs array<struct<text string, font string>>>"
BLOCK = "struct<type string, level int, text string, rows array<array<string>>>"
RAW_EXTRACTION = f"source string, content_type string, text string, engine string, page int, sheet string, fonts array<string>, native_unicode boolean, warnings array<string>, blocks array<{RAW_BLOCK}>"
NORMALIZED_DOC = f"source string, content_type string, text string, engine string, page int, sheet string, lang string, encoding_detected string, encoding_confidence double, warnings array<string>, blocks array<{BLOCK}>"
METADATA_FIELDS = ("source", "content_type", "page", "sheet", "lang", "encoding_detected", "encoding_confidence", "engine", "warnings")

#: ``BLOCK`` as a type object, for UDFs that are declared before a session exists.
BLOCK_TYPE = StructType().add("type", "string").add("level", "integer").add("text", "string").add("rows", ArrayType(ArrayType(StringType())))

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
PDF = "application/pdf"
RTF = "application/rtf"
OLE2 = "application/x-ole-storage"
UNKNOWN = "application/octet-stream"
