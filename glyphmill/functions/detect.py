"""Encoding verdicts as column expressions: STRUCT<encoding, confidence, method, font>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import charmaps
from .text import vietnamese_score

FONT, MIXED, UNICODE, ASSUMED = 0.95, 0.6, 0.9, 0.5
MARGIN, SEPARATION = 0.15, 0.05
BASE, MOST = 0.5, 0.85


def verdict(encoding: Column | None, confidence: Column | float, method: str, font: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct((null if encoding is None else encoding).alias("encoding"), confidence.alias("confidence"), F.lit(method).alias("method"), (null if font is None else font).alias("font"))


def font_encoding(font: Column) -> Column:
    """The legacy encoding that a font name implies: ``.Vn...`` TCVN3, ``VNI...`` VNI."""
    name = F.upper(F.regexp_replace(font, r"^[A-Z]{6}\+", ""))
    return F.when(F.startswith(name, F.lit(".VN")), "tcvn3").when(F.startswith(name, F.lit("VNI")), "vni")


def detect_fonts(fonts: Column) -> Column:
    """The verdict of an array of font names; null and empty names do not count."""
    usable = F.filter(fonts, lambda f: f.isNotNull() & (f != ""))
    legacy = F.filter(usable, lambda f: font_encoding(f).isNotNull())
    kinds = F.array_distinct(F.transform(legacy, font_encoding))
    first, font = F.get(kinds, 0), F.get(legacy, 0)
    return (
        F.when(F.size(kinds) == 1, verdict(first, FONT, "font-signal", font))
        .when(F.size(kinds) > 1, verdict(first, MIXED, "font-signal-mixed", font))
        .when(F.size(usable) > 0, verdict(None, UNICODE, "no-legacy-font"))
        .otherwise(verdict(None, ASSUMED, "assumed-unicode"))
    )


def gains(text: Column, candidates: tuple[str, ...] = charmaps.AUTO_DETECT) -> Column:
    """ARRAY<STRUCT<gain, name>>: how much each charmap raises the score, the best first."""
    base = vietnamese_score(text)
    rows = [F.struct((vietnamese_score(charmaps.apply(text, n)) - base).alias("gain"), F.lit(n).alias("name")) for n in candidates]
    return F.reverse(F.array_sort(F.array(*rows)))


def content_verdict(ranked: Column) -> Column:
    """The verdict from :func:`gains`: the best charmap, if it gains enough and stands out."""
    best = F.get(ranked, 0)
    second = F.coalesce(F.get(ranked, 1)["gain"], F.lit(0.0))
    unclear = (best["gain"] < MARGIN) | (best["gain"] - second < SEPARATION)
    return F.when(unclear, verdict(None, ASSUMED, "assumed-unicode")).otherwise(verdict(best["name"], F.least(F.lit(MOST), F.lit(BASE) + best["gain"]), "content-frequency"))
