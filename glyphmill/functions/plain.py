"""The text rules on Python strings, for the one crossing in which whole documents are normalised.

They equal the column expressions of :mod:`.text`, :mod:`.charmaps` and :mod:`.detect`, which serve
texts that need no normal form or stand in columns of their own.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from . import charmaps
from .detect import ASSUMED, BASE, FONT, MARGIN, MIXED, MOST, SEPARATION, UNICODE
from .text import score

_SUBSET = re.compile(r"^[A-Z]{6}\+")
_BLANK = re.compile(r"\n{3,}")


@lru_cache(maxsize=1)
def _unseen() -> re.Pattern[str]:
    """Control and format characters but for tab and line feed."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cc", "Cf") and c not in (9, 10)]
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


@lru_cache(maxsize=1)
def _spaces() -> list[str]:
    """White space that :func:`_unseen` leaves, but for the space, tab and line feed."""
    return [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and unicodedata.category(c) != "Cc" and c != " "]


def normal(text: str, form: str) -> str:
    return text if unicodedata.is_normalized(form, text) else unicodedata.normalize(form, text)


def clean(text: str) -> str:
    """As ``clean_chars``: without the final normal form."""
    if not text.replace("\n", "").replace("\t", "").isprintable():  # else it has none of what these steps change
        for old in ("\r\n", "\r", "\x0b", "\x0c"):
            text = text.replace(old, "\n")
        text = _unseen().sub("", text)
        for old in _spaces():
            text = text.replace(old, " ")
    return tidy(text)


def tidy(text: str) -> str:
    """The end of :func:`clean`, and all that cleaned texts put together still need."""
    while "  " in text:
        text = text.replace("  ", " ")
    text = "\n".join([line.strip(" ") for line in text.split("\n")])
    return (_BLANK.sub("\n\n", text) if "\n\n\n" in text else text).strip("\n")


@lru_cache(maxsize=None)
def _singles(encoding: str) -> np.ndarray | None:
    """What each character up to the last source becomes, if all sources and results are single ones."""
    pairs = charmaps.CHARMAPS[encoding]
    if not all(len(a) == len(b) == 1 for a, b in pairs):
        return None
    table = np.arange(max(ord(a) for a, _ in pairs) + 1, dtype=np.uint32)
    for a, b in pairs:
        table[ord(a)] = ord(b)
    return table


def convert(text: str, encoding: str | None) -> str:
    """The text converted by a charmap; unchanged if there is none of that name."""
    if encoding not in charmaps.CHARMAPS:
        return text
    if (table := _singles(encoding)) is not None:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(code < len(table), table.take(code, mode="clip"), code).tobytes().decode("utf-32-le", "surrogatepass")
    for old, new in charmaps.CHARMAPS[encoding]:
        text = text.replace(old, new)
    return text


class Verdict(NamedTuple):
    encoding: str | None
    confidence: float
    method: str


@lru_cache(maxsize=1 << 12)
def font_encoding(font: str | None) -> str | None:
    name = _SUBSET.sub("", font or "").upper()
    return "tcvn3" if name.startswith(".VN") else "vni" if name.startswith("VNI") else None


def detect_fonts(fonts: Iterable[str | None]) -> Verdict:
    usable = [f for f in fonts if f]
    kinds = list(dict.fromkeys(e for f in usable if (e := font_encoding(f))))
    if kinds:
        return Verdict(kinds[0], FONT, "font-signal") if len(kinds) == 1 else Verdict(kinds[0], MIXED, "font-signal-mixed")
    return Verdict(None, UNICODE, "no-legacy-font") if usable else Verdict(None, ASSUMED, "assumed-unicode")


def detect_content(text: str) -> Verdict:
    base = score(text)
    ranked = sorted(((score(convert(text, n)) - base, n) for n in charmaps.AUTO_DETECT), reverse=True)
    gain, name = ranked[0]
    if gain < MARGIN or gain - ranked[1][0] < SEPARATION:
        return Verdict(None, ASSUMED, "assumed-unicode")
    return Verdict(name, min(MOST, BASE + gain), "content-frequency")


def dominant(encodings: Iterable[str | None]) -> str | None:
    """The most frequent value that is not null; of equals the first."""
    legacy = [e for e in encodings if e is not None]
    return max(dict.fromkeys(legacy), key=legacy.count, default=None)
