"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a non-blank line without white space at its ends) is hashed to ``LANES`` numbers of 32
bits, taken from SHA-256 over a block number and the paragraph. A document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo 2**32. It does not depend on the order of
paragraphs, counts repeated ones, and follows an insertion or deletion by one addition or
subtraction; fingerprints of parts add up to that of the whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from .common import small_batches

BLOCKS = 4
LANES = 8 * BLOCKS
EMPTY = "0" * 8 * LANES
_EDGE = b" \t\r\v\f"


def paragraphs(text: str) -> list[bytes]:
    return [p for p in (x.strip(_EDGE) for x in text.encode().split(b"\n")) if p]


def vector(items: Iterable[bytes]) -> np.ndarray:
    """The sum of the items' vectors."""
    digests = b"".join(sha256(b"%d:" % i + p).digest() for p in items for i in range(BLOCKS))
    return np.frombuffer(digests, ">u4").reshape(-1, LANES).sum(axis=0, dtype=np.uint32)


def to_hex(v: np.ndarray) -> str:
    return v.astype(">u4").tobytes().hex()


def from_hex(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


_ROW = StructType().add("n_paragraphs", IntegerType()).add("fingerprint", StringType())


@F.pandas_udf(_ROW)
def _fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        items = [paragraphs(t or "") for t in part]
        yield pd.DataFrame({"n_paragraphs": [len(x) for x in items], "fingerprint": [to_hex(vector(x)) for x in items]})


def _combine(sign: int):
    @F.pandas_udf(StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([to_hex(from_hex(x) + np.uint32(sign & 0xFFFFFFFF) * from_hex(y)) if x and y else None for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def added(a: Column, b: Column) -> Column:
    """The fingerprint of all paragraphs of both; null if either is null."""
    return _combine(1)(a, b)


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` after deleting the paragraphs of ``b``; null if either is null."""
    return _combine(-1)(a, b)


def text_fingerprint(text: Column) -> Column:
    """STRUCT<n_paragraphs, fingerprint> of a text column."""
    return _fingerprint(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint) of each document, in one pass without a shuffle.

    Defined cases: a null text and one without paragraphs have 0 paragraphs and the fingerprint
    of all zeros; null ids stay; repeated rows give repeated rows; an empty table gives an empty
    result; other columns play no part.
    """
    small_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _fingerprint("text").alias("f"))
    return out.select("doc_id", "f.n_paragraphs", "f.fingerprint")


def equal_groups(docs: DataFrame) -> DataFrame:
    """(fingerprint, doc_ids) of the documents that have the same paragraphs in any order."""
    return fingerprints(docs).where("n_paragraphs > 0").groupBy("fingerprint").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids")).where("size(doc_ids) > 1")


def total(fingerprints: DataFrame, *by: str) -> DataFrame:
    """The fingerprint of each group's documents together, as one sum per lane on the JVM."""
    lanes = [F.sum(F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(LANES)]
    joined = F.concat(*[F.lpad(F.lower(F.hex((F.col(f"l{i}") % F.lit(1 << 32)).cast("long"))), 8, "0") for i in range(LANES)])
    return fingerprints.groupBy(*by).agg(*lanes).select(*by, F.coalesce(joined, F.lit(EMPTY)).alias("fingerprint"))


FINGERPRINT_SQL = f"""
with lines as (select doc_id, unnest(string_split(text, chr(10))) as line from documents),
items as (select doc_id, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as p from lines),
digests as (select doc_id, b, sha256(b || ':' || p) as h from items, range({BLOCKS}) t(b) where p <> ''),
lanes as (select doc_id, b * 8 + k as lane, sum(cast('0x' || substr(h, cast(k * 8 + 1 as integer), 8) as bigint)) % 4294967296 as v from digests, range(8) u(k) group by all),
found as (select doc_id, string_agg(printf('%08x', cast(v as bigint)), '' order by lane) as f from lanes group by doc_id),
counts as (select doc_id, count(*) as n from items where p <> '' group by doc_id)
select doc_id, cast(coalesce(n, 0) as integer) as n_paragraphs, coalesce(f, '{EMPTY}') as fingerprint
from documents left join found using (doc_id) left join counts using (doc_id)
"""
