"""Line deduplication by pairwise alignment.

Documents that share a rare anchor are aligned by patience diff, and the aligned common blocks are
deleted from the later document, the one with the larger ``doc_id``. An *anchor* is the hash of a
shortest run of non-blank lines with at least ``WORDS`` words: mostly one line, several where lines
are short. Every common block of that many words is covered by anchors that both documents have.

Each later document is aligned to the first holder of each of its anchors, so the pairs are at most
as many as the anchors, never the square of a group of copies. No overlap is lost by that: if any
earlier document has a block, it has the anchors that cover it, and the first holders of these
have them too, so the alignments with those find every line of the block.

An anchor in more than ``RARE`` documents is no longer rare. It needs no alignment, since its own
lines are the common block. What is deleted is the same for every ``RARE``, which only settles how
it is found; a block of fewer than ``WORDS`` words stays, so lines which agree by chance are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import attached, fresh, mix, slices, small_batches, stored, token_hashes

RARE = 200
WORDS = 8

_KEEP = np.arange(256, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The aligned positions (in a, in b) of equal lines, by patience diff.

    Equal heads and tails are aligned first; then the lines that are unique in both parts, as far
    as their order agrees (a longest increasing sequence), and the gaps between them likewise.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo == hi or low == high:
            continue
        here, there = Counter(a[lo:hi]), Counter(b[low:high])
        place = {b[j]: j for j in range(low, high) if there[b[j]] == 1 and here.get(b[j]) == 1}
        tops: list[int] = []
        piles: list[tuple[int, int, int]] = []  # (i, j, index of the pair before it)
        last: list[int] = []
        for i in range(lo, hi):
            j = place.get(a[i])
            if j is None:
                continue
            k = bisect_left(tops, j)
            piles.append((i, j, last[k - 1] if k else -1))
            if k == len(tops):
                tops.append(j)
                last.append(len(piles) - 1)
            else:
                tops[k], last[k] = j, len(piles) - 1
        chain, at = [], last[-1] if last else -1
        while at >= 0:
            i, j, at = piles[at]
            chain.append((i, j))
        chain.reverse()
        out += chain
        if chain:
            ends = [(lo - 1, low - 1), *chain, (hi, high)]
            todo += [(p + 1, q, r + 1, s) for (p, r), (q, s) in zip(ends, ends[1:], strict=False) if q > p + 1 and s > r + 1]
    return sorted(out)


def _spans(lines: list[int], words: Mapping[int, int], least: int) -> Iterator[tuple[int, int]]:
    """The (begin, end) of the shortest runs of at least ``least`` words from each line on and up to each line.

    Only lines in ``words`` count, and others end a run. Together these runs cover just the lines
    of all runs of at least ``least`` words.
    """
    size = len(lines)
    for back in (False, True):
        given = lines[::-1] if back else lines
        begin = total = 0
        for end, line in enumerate(given):
            if line not in words:
                begin, total = end + 1, 0
                continue
            total += words[line]
            while begin < end and total - words[given[begin]] >= least:
                total -= words[given[begin]]
                begin += 1
            if total >= least:
                yield (size - end - 1, size - begin) if back else (begin, end + 1)


def common(later: list[int], words: list[int], earlier: list[int], least: int) -> set[int]:
    """Positions of the later document's lines in any run of at least ``least`` words that the earlier one has.

    Neither the order of the runs nor their number in either document matters.
    """
    shared = set(earlier).intersection(later)
    weigh = {x: n for x, n in zip(later, words, strict=True) if x in shared}
    have = {tuple(earlier[i:j]) for i, j in _spans(earlier, weigh, least)}
    return {x for i, j in _spans(later, weigh, least) if tuple(later[i:j]) in have for x in range(i, j)}


def blocks(later: list[int], words: list[int], earlier: list[int], least: int) -> list[int]:
    """Positions of the later document's lines in common blocks of at least ``least`` words.

    A block is a run of equal lines that are neighbours in both documents. The patience diff finds
    those in order; what it leaves, blocks that are repeated or moved, is compared exactly.
    """
    out: list[int] = []
    run: list[int] = []
    before = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (before[0] + 1, before[1] + 1):
            if run and sum(words[x] for x in run) >= least:
                out += run
            run = []
        run.append(i)
        before = (i, j)
    found, have = set(out), set(earlier)
    if any(x in have for i, x in enumerate(later) if i not in found):
        found |= common(later, words, earlier, least)
    return sorted(found)


def text_lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the non-blank lines of a run of texts: hashes of their words, numbers of words, positions
    in their text, and each text's bounds among them."""
    word, start, bounds = token_hashes(data, at, fold=_KEEP)
    row = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[start] + row
    first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(word) else np.zeros(0, np.int64)
    count = np.diff(first, append=len(word))
    place = (np.arange(len(word)) - np.repeat(first, count)).astype(np.uint64)
    hashes = mix(np.add.reduceat(mix(word + place * np.uint64(_BASE)), first) + count.astype(np.uint64)) if len(word) else word
    return hashes, count, breaks[start[first]] - breaks[at[row[first]]], np.searchsorted(row[first], np.arange(len(at)))


def anchors(hashes: np.ndarray, words: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the shortest runs of at least ``least`` words from each line on and up to
    each line, none across the bounds of a text."""
    n = len(hashes)
    total = np.concatenate(([0], np.cumsum(words)))
    low, high = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
    each = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least, "left")
    on = np.flatnonzero(end <= high)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    back = np.flatnonzero((total[1:] >= least) & (begin >= low))
    runs = np.unique(np.concatenate((np.stack([each[on], end[on]]), np.stack([begin[back], each[back] + 1])), axis=1), axis=1)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, _BASE, np.uint64)) if n else np.zeros(0, np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)))
        inverse = np.cumprod(np.full(n, _BACK, np.uint64)) if n else power
        i, j = runs
        return i, j, mix((sums[j] - sums[i]) * inverse[i] + (j - i).astype(np.uint64))


def _nested(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _features(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, at in slices(batch.column("text")):
                hashes, words, places, bounds = text_lines(data, at)
                begin, _, found = anchors(hashes, words, bounds, least)
                owner = np.searchsorted(bounds, begin, "right") - 1
                order = np.lexsort((found, owner))
                owner, found = owner[order], found[order]
                new = np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])) if len(found) else np.zeros(0, bool)
                owner, found = owner[new], found[new]
                part = batch.slice(first, len(at) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("fp"),
                        _nested(hashes.view(np.int64), bounds, pa.int64()),
                        _nested(words, bounds, pa.int32()),
                        _nested(places, bounds, pa.int32()),
                        _nested(found.view(np.int64), np.searchsorted(owner, np.arange(len(at))), pa.int64()),
                    ],
                    ["doc_id", "fp", "lines", "words", "places", "anchors"],
                )

    return run


def _deleted(least: int):
    """Positions in the later text that an alignment with ``earlier`` finds, or that anchors in ``hot`` cover."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def run(later: pd.Series, words: pd.Series, places: pd.Series, earlier: pd.Series, hot: pd.Series) -> pd.Series:
        out = []
        for x, w, p, y, h in zip(later, words, places, earlier, hot, strict=True):
            if y is not None:
                rows = blocks(x.tolist(), w.tolist(), y.tolist(), least)
            else:
                i, j, found = anchors(x.view(np.uint64), w, np.array([0, len(x)]), least)
                hit = np.isin(found.view(np.int64), h)
                edge = np.zeros(len(x) + 1, np.int64)
                np.add.at(edge, i[hit], 1)
                np.add.at(edge, j[hit], -1)
                rows = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            out.append(p[rows])
        return pd.Series(out, dtype=object)

    return run


def repeated_lines(docs: DataFrame, rare: int = RARE, least: int = WORDS) -> DataFrame:
    """(doc_id, fp, positions): the lines of each text that an earlier document has in a common block.

    Positions count the text's lines from 0, blank ones included; texts without any are left out.
    ``fp`` is the text's ``xxhash64``. Lines are equal if their words between ASCII white space are,
    and are compared by 64-bit hashes. Defined cases: a null ``doc_id`` or text has no lines here; an
    empty table gives an empty result; rows of one ``doc_id`` are none earlier than the other, each
    is compared with all rows of smaller ids; equal rows give one row; other columns play no part.
    """
    small_batches(docs.sparkSession)
    base = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), "text")
    made = base.mapInArrow(_features(least), "doc_id long, fp long, lines array<long>, words array<int>, places array<int>, anchors array<long>")
    texts = stored(made.where("size(anchors) > 0"), "lines")
    each = texts.select("doc_id", "fp", F.explode("anchors").alias("hash"))
    shared = stored(each.groupBy("hash").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where("docs > 1"), "shared")

    hits = stored(attached(each, shared, "hash", "docs").where("doc_id > first").select("doc_id", "fp", "first", F.when(F.col("docs") > rare, F.col("hash")).alias("hot")), "hits")
    pairs = hits.where("hot is null").select("doc_id", "fp", "first").distinct()
    other = texts.select(F.col("doc_id").alias("first"), F.col("lines").alias("earlier"))
    none = F.lit(None).cast("array<long>")
    tasks = pairs.join(other, "first").select("doc_id", "fp", "earlier", none.alias("hot"))
    covered = hits.where("hot is not null").groupBy("doc_id", "fp").agg(F.collect_set("hot").alias("hot")).select("doc_id", "fp", none.alias("earlier"), "hot")
    own = texts.dropDuplicates(["doc_id", "fp"]).select("doc_id", "fp", "lines", "words", "places")
    found = tasks.unionByName(covered).join(own, ["doc_id", "fp"]).select("doc_id", "fp", F.explode(_deleted(least)("lines", "words", "places", "earlier", "hot")).alias("pos"))
    return found.groupBy("doc_id", "fp").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def _without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for text, drop in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        if drop is None:
            out.append(None)
            continue
        away = set(drop)
        out.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in away))
    return pa.array(out, pa.string())


def deduplicate(docs: DataFrame, rare: int = RARE, least: int = WORDS, drop_empty: bool = False, count: str | None = None) -> DataFrame:
    """The documents with the lines of :func:`repeated_lines` deleted from ``text``.

    All columns stay; ``n_chars``, if there is one, follows the text. ``count`` names a column to
    add with the number of deleted lines. With ``drop_empty``, documents of which no word is left
    after a deletion go. A row that loses nothing is returned unchanged, nulls included.
    """
    key, print_, gone, kept = (fresh(docs.columns, x) for x in ("key", "fp", "gone", "kept"))
    marks = repeated_lines(docs, rare, least).select(F.col("doc_id").alias(key), F.col("fp").alias(print_), F.col("positions").alias(gone))
    out = docs.join(marks, (docs["doc_id"] == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(print_)), "left")
    cut = F.arrow_udf(_without, StringType()).asNondeterministic()
    out = out.withColumn(kept, cut(F.when(F.col(gone).isNotNull(), F.col("text")), F.col(gone)))
    if drop_empty:
        out = out.where(F.col(gone).isNull() | F.col(kept).rlike(r"\S"))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.col(kept))
    columns = [text.alias("text") if c == "text" else F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(kept)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, *([F.coalesce(F.size(gone), F.lit(0)).alias(count)] if count else []))


def deduplicate_sql(least: int = WORDS) -> str:
    """The texts and numbers of deleted lines in DuckDB, by comparing the runs of lines themselves, for
    documents whose ids differ."""
    return f"""
with texts as (select doc_id, text, string_split(text, chr(10)) as l from documents),
each as (select doc_id, unnest(range(len(l))) as pos, trim(regexp_replace(unnest(l), '[\\x09-\\x0d\\x1c-\\x20]+', ' ', 'g')) as line from texts),
kept as (select *, row_number() over (partition by doc_id order by pos) as i, len(string_split(line, ' ')) as w from each where line <> ''),
lists as (select doc_id, list(line order by i) as ls, list(pos order by i) as ps, list_prepend(0, list(c order by i)) as sums from (select *, cast(sum(w) over (partition by doc_id order by i) as bigint) as c from kept) group by doc_id),
ends as (select *, unnest(range(1, len(ls) + 1)) as i from lists),
runs as (select doc_id, ls, ps, i as a, len(list_filter(sums, lambda x: x < sums[i] + {least})) as b from ends where sums[len(sums)] >= sums[i] + {least}
  union select doc_id, ls, ps, len(list_filter(sums, lambda x: x <= sums[i + 1] - {least})) as a, i as b from ends where sums[i + 1] >= {least}),
keyed as (select doc_id, ps, a, b, array_to_string(ls[a : b], chr(10)) as key from runs),
firsts as (select key, min(doc_id) as first from keyed group by key),
gone as (select distinct doc_id, unnest(ps[a : b]) as pos from keyed join firsts using (key) where first < doc_id),
lost as (select doc_id, list(pos) as g from gone group by doc_id)
select doc_id, case when g is null then text else array_to_string(list_filter(l, lambda x, i: not list_contains(g, i - 1)), chr(10)) end as text, cast(coalesce(len(g), 0) as integer) as n_removed
from texts left join lost using (doc_id)
"""
