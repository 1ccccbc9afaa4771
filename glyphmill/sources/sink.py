"""Writing documents out as one file each, and the command line."""

from __future__ import annotations

import argparse
import os
import sys
from itertools import chain, count
from pathlib import Path

from pyspark.sql import SparkSession

from ..errors import ConfigError
from ..options import FILE, load_settings, resolve, UNSET
from . import reader
from .parsers import doctor

SUFFIX = {"markdown": ".md", "text": ".txt", "json": ".json"}


def free_name(path: str, output: str, used: set[str]) -> str:
    """A file name for a document: its source's stem, with -1, -2 and so on as long as that is taken."""
    stem = Path(path).stem
    endings = chain([""], (f"-{k}" for k in count(1)))
    name = next(x for e in endings if (x := stem + e + SUFFIX[output]) not in used)
    used.add(name)
    return name


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv == ["doctor"]:
        for name, ready in doctor().items():
            print(f"{name}: {'ready' if ready else 'something is missing'}")
        return 0
    parser = argparse.ArgumentParser(prog="glyphmill", description=f"Documents to clean Unicode text. Defaults come from {FILE}.")
    parser.add_argument("paths", nargs="+")
    parser.add_argument("--output", choices=list(SUFFIX), default=UNSET)
    parser.add_argument("--encoding", default=UNSET)
    parser.add_argument("--ocr", action=argparse.BooleanOptionalAction, default=UNSET)
    parser.add_argument("--normalize", default=UNSET)
    parser.add_argument("--out", help="a folder; without it the documents go to standard output")
    a = parser.parse_args(argv)
    try:
        settings = resolve(load_settings(), output=a.output, encoding=a.encoding, ocr=a.ocr, normalize=a.normalize)
    except ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.getOrCreate()
    found = reader.load_batch(spark, reader.expand(a.paths, spark), settings=settings).orderBy("seq")
    failed, shown, used = 0, [], set()
    for row in found.select("text", "error", "metadata.source").toLocalIterator():
        if row["error"] is not None:
            failed += 1
            print(f"{row['source']}: {row['error']}", file=sys.stderr)
        elif a.out:
            os.makedirs(a.out, exist_ok=True)
            Path(a.out, free_name(row["source"], settings.output, used)).write_text(row["text"] + "\n", "utf-8")
        else:
            shown.append(row["text"])
    if shown:
        print("\n\n".join(shown))
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
