"""``spark.read.format("glyphmill_documents")``: raw extractions as a Python data source.

Files are dealt to partitions of about ``BYTES``, small ones together, so that a folder of many of them
is not a task each. Failures are rows, as in :mod:`.reader`, whose rules are used here too.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S
from ..errors import DocumentError, UnsafeInput, UnsupportedFormat
from .parsers import DEFAULT, Registry
from .sniff import WINDOW, classify_zip

BYTES, FILES = 32 << 20, 1000  # of a partition, at most, unless one file is larger


def content_type(path: str, content: bytes) -> str:
    for magic, kind in ((b"%PDF-", S.PDF), (bytes.fromhex("D0CF11E0A1B11AE1"), S.OLE2), (b"{\\rtf", S.RTF), (b"\xef\xbb\xbf{\\rtf", S.RTF)):
        if content.startswith(magic):
            return kind
    zipped = content.startswith(b"PK\x03\x04")
    found = classify_zip(content) if zipped else None
    if found in (None, "corrupt"):
        raise UnsupportedFormat(f"{'corrupt or unknown ZIP container' if zipped else 'unknown format'}: {path} (first bytes {content[:4].hex().upper()})")
    return found


def packed(sizes: list[tuple[str, int]], most: int = BYTES, files: int = FILES) -> list[list[str]]:
    """Neighbouring files together, up to ``most`` bytes and ``files`` files."""
    out: list[list[str]] = []
    total = 0
    for path, size in sizes:
        if not out or total + size > most or len(out[-1]) == files:
            out.append([])
            total = 0
        out[-1].append(path)
        total += size
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.limit = int(options.get("maxbytes", 100 << 20))
        self.ocr = {"true": True, "false": False}.get(options.get("ocr", "").lower())

    def _system(self) -> tuple[pafs.FileSystem, str, str]:
        """The file system of the path, the path in it, and what names of files begin with."""
        if "://" not in self.path:
            return pafs.LocalFileSystem(), self.path, ""
        return *pafs.FileSystem.from_uri(self.path), self.path.split("://")[0] + "://"

    def partitions(self) -> list[InputPartition]:
        from .reader import expand

        fs, root, prefix = self._system()
        if prefix:
            info = fs.get_file_info(root)
            folder = info.type == pafs.FileType.Directory
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if folder else [info]
            names = sorted((f.path, f.size or 0) for f in found if not folder or f.is_file and f.path.endswith(".docx"))
        else:
            names = [(p, fs.get_file_info(p).size or 0) for p in expand([root])]
        return [InputPartition(group) for group in packed(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from .reader import parse_one

        fs, _, prefix = self._system()
        registry = Registry(DEFAULT)
        for name in partition.value:
            path, kind = prefix + name, None
            try:
                size = fs.get_file_info(name).size
                if size is not None and size > self.limit:
                    raise UnsafeInput(f"{path} has {size} bytes; the limit is {self.limit}")
                with fs.open_input_stream(name, compression=None) as f:
                    content = f.read()
                kind = content_type(path, content)
                hint = False if kind == S.PDF and b"/Font" in content[:WINDOW] else None
                r = parse_one(registry, self.ocr, path, kind, hint, content)
            except (DocumentError, OSError) as e:
                r = {"error_class": type(e).__name__ if isinstance(e, DocumentError) else "OSError", "error": str(e)}
            blocks = None
            if "blocks" in r:
                blocks = [(b["type"], b.get("level"), b.get("text"), b.get("rows"), b.get("fonts"), [(x["text"], x["font"]) for x in b["runs"]] if "runs" in b else None) for b in r["blocks"]]
            yield (path, kind, *(r.get(c) for c in ("text", "engine", "page", "sheet", "fonts", "native_unicode", "warnings")), blocks, r.get("error_class"), r.get("error"))


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "glyphmill_documents"

    def schema(self) -> str:
        return S.RAW_EXTRACTION + ", error_class string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
