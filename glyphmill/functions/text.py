"""Text functions as column expressions: cleanup, normal forms, tokens, the character score."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .slices import by_slices, in_slices

FORMS = ("NFC", "NFD", "NFKC", "NFKD")

# Java's white space with (?U) lacks only U+001C-1F of Python's; its Cf and Cc lack nine newer code points.
_WS = r"[\s\x1c-\x1f]"
_STRIP = r"[\p{Cc}\p{Cf}\x{890}\x{891}\x{13439}-\x{1343f}&&[^\t\n]]"
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"


def trim_ws(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_WS}+|{_WS}+\z", "")


def _normal(values: pa.Array, form: str) -> pa.Array:
    return pa.array([None if x is None else x if unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x) for x in values.to_pylist()], pa.string())


@lru_cache(maxsize=None)
def _form_udf(form: str):
    if form not in FORMS:
        raise ValueError(f"form must be one of {list(FORMS)}, got {form!r}")
    # not deterministic in name only: else the optimizer could copy the call into the lambda of a
    # later higher-order function, where Python cannot be evaluated
    return by_slices(lambda values: _normal(values, form), StringType()).asNondeterministic()


def normal_form(text: Column, form: str = "NFC") -> Column:
    """The text in a Unicode normal form. Spark has none, so this is the one step in Python; use it
    last in a chain and once a column."""
    return _form_udf(form)(text)


@lru_cache(maxsize=None)
def _is_udf(form: str):
    return in_slices(lambda values: pa.array([None if x is None else unicodedata.is_normalized(form, x) for x in values.to_pylist()], pa.bool_()), BooleanType(), pa.bool_())


def is_normal_form(text: Column, form: str = "NFC") -> Column:
    """Whether the text is in a normal form, as a check of texts that should be."""
    return _is_udf(form)(text)


def clean_chars(text: Column) -> Column:
    """The cleanup without the final normal form: line ends unified, control and format characters
    dropped, spaces collapsed within lines and trimmed, blank lines capped at one, ends stripped."""
    steps = ((r"\r\n?|[\x0b\x0c]", "\n"), (_STRIP, ""), (r"(?U)[^\S\t\n]+", " "), (r"(?m)^ +| +$", ""), (r"\n{3,}", "\n\n"), (r"^\n+|\n+\z", ""))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def clean_text(text: Column, form: str = "NFC") -> Column:
    return normal_form(clean_chars(text), form)


def estimate_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, rf"(?U){_WS}+"), lambda x: x != ""))


# counts of the 797 letters of the model's text
_COUNTS = "176: |96:n|49:g|44:t|41:h|39:i|38:c|19:a|15:m|14:vôữ|12:à|11:lđệ|10:ưộ|9:,u|8:kors|7:áạ|6:dâếố|5:.ợ|4:yậờủứ|3:bpíảềểớ|2:5qêóơấởự|1:%8efãéùũẳẹẻọồổụừửỳ"
COUNTS = {c: int(n) for n, _, chars in (x.partition(":") for x in _COUNTS.split("|")) for c in chars}
_TOTAL = sum(COUNTS.values()) + len(COUNTS)
LOG_PROB = {c: math.log((n + 1) / _TOTAL) for c, n in COUNTS.items()}
FLOOR = math.log(1 / _TOTAL)


@lru_cache(maxsize=1)
def _scores() -> np.ndarray:
    out = np.full(0x110000, FLOOR)
    for c, p in LOG_PROB.items():
        out[ord(c)] = p
    return out


def score(text: str) -> float:
    """The mean log probability of a text's characters, in lower case and NFC; of none, the floor."""
    code = np.frombuffer(unicodedata.normalize("NFC", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    return float(_scores()[code].mean()) if len(code) else FLOOR


@lru_cache(maxsize=1)
def _score_udf():
    return in_slices(lambda texts: pa.array([None if t is None else score(t) for t in texts.to_pylist()], pa.float64()), DoubleType(), pa.float64()).asNondeterministic()


def vietnamese_score(text: Column) -> Column:
    """How well the text's characters fit Vietnamese: the mean of their log probabilities.

    Lower case and NFC are needed first, so the sum is taken in the same crossing to Python, by a
    table lookup over all characters; an expression would be interpreted character by character.
    """
    return _score_udf()(text)
