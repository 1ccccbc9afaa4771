"""Byte-level BPE, with pre-tokenisation by an associative scan instead of a regex.

The usual pattern of this tokenizer family (contractions, runs of letters, of numbers and of other
characters with one space before them, and white space that leaves its last character to what
follows) is an automaton over character classes. All texts of a slice are one array of code points;
each is mapped to a symbol by class tables and a look at its neighbours. A symbol is a function from
state to state, and the functions' compositions form a small monoid with a multiplication table.
A blocked scan composes them: within blocks for all blocks at once, then over the blocks' totals.
The state before each character then says whether a piece begins there.

Pieces are merged by rank, each distinct one once as long as the cache holds it. Every token's
first byte is kept, so that any range of tokens can be decoded and found in the text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import slices, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # only the default of a parameter
CACHE = 500_000  # pieces a worker remembers before it starts afresh

LETTER, NUMBER, OTHER, CUE1, CUE2, SPACE_IN, SPACE_LEAD, SPACE_LAST = range(8)
# states: a piece ended / in letters / numbers / others / white space / after a leading space / 1 or 2 letters of a contraction to come
DONE, IN_L, IN_N, IN_O, IN_S, LEAD, MORE1, MORE2 = range(8)
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLOCK = 512
NEVER = 1 << 30
WIDE = 40  # longer pieces are merged one by one


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state and whether a piece begins at this character."""
    if state == MORE2:
        return MORE1, False
    if state == MORE1:
        return DONE, False
    if symbol in (LETTER, NUMBER):
        own = IN_L if symbol == LETTER else IN_N
        return own, state not in (own, LEAD)
    if symbol in (OTHER, CUE1, CUE2):
        if state in (IN_O, LEAD):
            return IN_O, False
        return {OTHER: IN_O, CUE1: MORE1, CUE2: MORE2}[symbol], True
    if symbol == SPACE_IN:
        return IN_S, state != IN_S
    return (LEAD if symbol == SPACE_LEAD else DONE), True


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes by code point; the monoid's functions, their products, and the numbers in it of the
    symbols' functions, first inside a text and then at its beginning; beginnings by state and symbol."""
    classes = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            classes[c] = LETTER if kind == "L" else NUMBER
    classes[list(_WHITE)] = SPACE_IN
    inside = [tuple(step(s, x)[0] for s in range(8)) for x in range(8)]
    reset = [(step(DONE, x)[0],) * 8 for x in range(8)]
    functions = list(dict.fromkeys(inside + reset))
    known = {f: i for i, f in enumerate(functions)}
    i = 0
    while i < len(functions):
        for g in [*inside, *reset]:
            product = tuple(g[s] for s in functions[i])
            if product not in known:
                known[product] = len(functions)
                functions.append(product)
        i += 1
    product = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    begins = np.array([[step(s, x)[1] for x in range(8)] for s in range(8)])
    return classes, np.array(functions, np.uint8), product, np.array([[known[f] for f in inside], [known[f] for f in reset]], np.uint16), begins


def symbols(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The symbol of each code point; ``first`` marks the first one of each text."""
    out = tables()[0][code]
    white = out == SPACE_IN
    last = np.append(first[1:], True)
    ends = white & ~last
    ends[:-1] &= ~white[1:]
    out[ends] = np.where(code[ends] == 32, SPACE_LEAD, SPACE_LAST)
    cue = np.flatnonzero((code == 39) & ~last)
    if len(cue):
        one = code[cue + 1]
        out[cue[np.isin(one, [ord(c) for c in "sdmt"])]] = CUE1
        two = (cue + 2 < len(code)) & ~last[cue + 1]
        other = code[np.minimum(cue + 2, len(code) - 1)]
        pair = (one == 108) & (other == 108) | (one == 118) & (other == 101) | (one == 114) & (other == 101)
        out[cue[two & pair]] = CUE2
    return out


def scan(function: np.ndarray) -> np.ndarray:
    """The state after each symbol, by composing the function numbers of all symbols up to it."""
    _, functions, product, _, _ = tables()
    apply, table, m, n = functions.ravel(), product.ravel(), len(functions), len(function)
    rows = -(-n // BLOCK)
    grid = np.zeros((rows, BLOCK), np.int64)
    grid.ravel()[:n] = function
    grid = np.ascontiguousarray(grid.T)  # a block is a column, so a step over all blocks is contiguous
    for i in range(1, BLOCK):
        grid[i] = table.take(grid[i - 1] * m + grid[i])
    entry = np.full(rows, DONE)
    if rows > 1:
        if rows <= BLOCK:
            for k, f in enumerate(grid[-1, :-1].tolist()):
                entry[k + 1] = functions[f, entry[k]]
        else:
            entry[1:] = scan(grid[-1, :-1])
    return apply.take(grid * 8 + entry).T.ravel()[:n]


def boundaries(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The code points at which a piece begins."""
    _, _, _, numbers, begins = tables()
    symbol = symbols(code, first)
    function = numbers[0].take(symbol)
    function[first] = numbers[1].take(symbol[first])
    state = np.empty(len(code), np.uint8)
    state[:1] = DONE
    state[1:] = scan(function)[:-1]
    found = begins.ravel().take(state * np.uint8(8) + symbol)
    found[first] = True
    return np.flatnonzero(found)


class Codec:
    """A vocabulary: byte strings to ranks, which are the ids."""

    def __init__(self, data: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for w, r in self.ranks.items():
            words[r] = w
        self.length = np.array([len(w) for w in words])
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        joins = {(ranks[w[:k]] * size + ranks[w[k:]], r) for ranks in [self.ranks] for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks}
        keys, values = (np.array(x, np.int64) for x in zip(*sorted(joins), strict=True))
        # open addressing: a pair's slot is the first free one from its hash on
        self.slots = 1 << int(2 * len(keys)).bit_length()
        self.key, self.value = np.full(self.slots + 64, -1), np.full(self.slots + 64, NEVER, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        self.tries = 0
        while len(todo):
            self.tries += 1
            free = self.key[at] < 0
            self.key[at[free]] = keys[todo[free]]  # of several the last stays
            won = self.key[at] == keys[todo]
            self.value[at[won]] = values[todo[won]]
            todo, at = todo[~won], at[~won] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (self.slots - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of what two ids join to, ``NEVER`` if they do not."""
        keys = a.astype(np.int64) * len(self.length) + b
        at = self._slot(keys)
        have, out = self.key.take(at), self.value.take(at)
        miss = have != keys
        out[miss] = NEVER
        open_ = np.flatnonzero(miss & (have >= 0))
        for _ in range(self.tries - 1):
            at[open_] += 1
            hit = self.key[at[open_]] == keys[open_]
            out[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (self.key[at[open_]] >= 0)]
            if not len(open_):
                break
        return out

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as packed 32-bit numbers.

        In each piece the pair of least rank, the leftmost of equals, is joined again and again;
        a round makes one join in every piece of about one length.
        """
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for lo, hi in ((0, 6), (6, 10), (10, 16), (16, 24), (24, WIDE)):
            chosen = np.flatnonzero((lengths > lo) & (lengths <= hi))
            if not len(chosen):
                continue
            data = np.frombuffer(b"".join([pieces[i].ljust(hi, b"\0") for i in chosen]), np.uint8).reshape(-1, hi)
            size, column = lengths[chosen].copy(), np.arange(hi)
            ids = self.single[data]
            pair = np.full((len(chosen), hi), NEVER, np.int32)
            inner = column[None, :] < size[:, None] - 1
            pair[inner] = self.rank(ids[:, :-1][inner[:, :-1]], ids[:, 1:][inner[:, :-1]])
            live = np.arange(len(chosen))
            final = ids
            while len(live):
                at = pair.argmin(axis=1)
                least = pair[np.arange(len(live)), at]
                going = least < NEVER
                if not going.all():
                    final[live[~going]] = ids[~going]
                    live, ids, pair, at, least = live[going], ids[going], pair[going], at[going], least[going]
                    if not len(live):
                        break
                elif final is ids:
                    final = ids.copy()
                row = np.arange(len(live))
                ids[row, at] = least
                move = np.minimum(column + (column > at[:, None]), hi - 1)
                flat = row[:, None] * hi
                ids = ids.ravel().take(flat + move)
                pair = pair.ravel().take(flat + np.minimum(column + (column >= at[:, None]), hi - 1))
                size[live] -= 1
                left = size[live]
                pair[row, left - 1] = NEVER
                some = np.flatnonzero(at < left - 1)
                pair[some, at[some]] = self.rank(ids[some, at[some]], ids[some, at[some] + 1])
                some = np.flatnonzero(at > 0)
                pair[some, at[some] - 1] = self.rank(ids[some, at[some] - 1], ids[some, at[some]])
            for i, k, n in zip(chosen.tolist(), range(len(chosen)), size.tolist(), strict=True):
                out[i] = final[k, :n].tobytes()
        for i in np.flatnonzero(lengths > WIDE).tolist():
            out[i] = np.array(self._long(pieces[i]), np.int32).tobytes()
        return out

    def _long(self, piece: bytes) -> list[int]:
        """As :meth:`merge` for one piece with a heap, in n log n steps, for long runs of one sign and the like."""
        ranks, n = self.ranks, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            alive[j] = False
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, byte offset of each token in its text, and each text's bounds among them."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        raw = data.tobytes()
        code = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        byte = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each code point
        starts = at[:-1][np.diff(at) > 0]
        first = np.zeros(len(code), bool)
        first[np.searchsorted(byte, starts)] = True
        begin = byte[boundaries(code, first)]
        cuts = np.append(begin, len(raw)).tolist()
        pieces = [raw[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]
        cache = self.cache
        if len(cache) >= CACHE:
            cache.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in cache]
        cache.update(zip(new, self.merge(new), strict=True))
        out = [cache[p] for p in pieces]
        ids = np.frombuffer(b"".join(out), np.int32)
        size = self.length[ids]
        offset = np.cumsum(size) - size
        bounds = np.searchsorted(offset, at)
        bounds[-1] = len(ids)
        return ids, (offset - np.repeat(at[:-1], np.diff(bounds))).astype(np.int32), bounds

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        total = np.cumsum(size)
        return self.bytes[np.repeat(self.begin[ids] - total + size, size) + np.arange(total[-1] if len(total) else 0)].tobytes()

    def span(self, ids: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[int, bytes]:
        """Where tokens lo..hi-1 begin in the text, and their bytes."""
        return (int(offsets[lo]) if lo < len(offsets) else 0), self.decode(ids[lo:hi])


@lru_cache(maxsize=4)
def codec(data: bytes) -> Codec:
    return Codec(data)


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, of about a megabyte, read where the job starts; it goes to the workers with
    the function, so that they need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets, round_trip) of each document, in one pass without a shuffle.

    ``offsets`` are the tokens' first bytes in the UTF-8 text; ``round_trip`` says whether decoding
    the ids gave the text's bytes again. Defined cases: a null text has nulls but for ``doc_id``; an
    empty text has no tokens; special tokens' strings are ordinary text; repeated rows give
    repeated rows; an empty table gives an empty result; other columns play no part.
    """

    data = read_vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(data)
        for batch in batches:
            texts = batch.column("text")
            ids, offsets, counts, good = [], [], [], []
            for _, raw, at in slices(texts):
                i, o, bounds = tool.encode(raw, at)
                back = np.frombuffer(tool.decode(i), np.uint8)
                same = len(back) == len(raw)
                wrong = np.flatnonzero(back != raw) if same else np.arange(len(raw))
                good.append(np.diff(np.searchsorted(wrong, at)) == 0)
                ids.append(i)
                offsets.append(o)
                counts.append(np.diff(bounds))
            count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            null = np.asarray(texts.is_null())
            edges = pa.array(np.append(0, np.cumsum(count)).astype(np.int32), mask=np.append(null, False))
            flat = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in (ids, offsets)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count, pa.int32(), mask=null), *(pa.ListArray.from_arrays(edges, pa.array(x, pa.int32())) for x in flat), pa.array(np.concatenate(good) if good else [], pa.bool_(), mask=null if len(null) else None)],
                ["doc_id", "n_tokens", "ids", "offsets", "round_trip"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens int, ids array<int>, offsets array<int>, round_trip boolean")


def decode_ids(encoded: DataFrame, vocabulary: str = VOCABULARY, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the decoded text of a column of ids; bytes that are no UTF-8 become U+FFFD; null stays null."""
    data = read_vocabulary(vocabulary)

    @F.pandas_udf(StringType())
    def run(column: pd.Series) -> pd.Series:
        tool = codec(data)
        return pd.Series([None if x is None else tool.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in column], dtype=object)

    return encoded.withColumn(text, run(F.col(ids)))
