"""Best-fit packing by bin completion with branch and bound.

Documents are cut into pieces of at most ``CAPACITY`` tokens, and pieces are packed into bins.
Pieces are dealt by hash to groups of about ``GROUP`` pieces, which are packed apart: the groups
keep one size whatever the input's. In a group, a bin is completed around the largest piece left;
the fillings around it that no other filling dominates are enumerated, of any number of pieces,
those of larger pieces first; a branch ends when its waste exceeds what a better packing may have.
The best-fit decreasing solution is the first incumbent. ``NODES`` bounds the branches of a group;
when it is used up the incumbent stands, so every piece is always packed. ``proof`` tells for each
group how its packing ended: ``bound`` (as few bins as the tokens need), ``search`` (no better
packing exists) or ``budget`` (the branches were used up).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

CAPACITY = 2048
GROUP = 4096
NODES = 20000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the bins as lists of sizes."""
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    out: list[list[int]] = []
    for s in sorted(sizes, reverse=True):
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
            out[b].append(s)
        else:
            free, b = capacity, len(out)
            out.append([s])
        if free - s:
            left = (free - s, b)
            room.insert(bisect_left(room, left), left)
    return out


def dominated(filling: tuple[int, ...], left: int, waste: int) -> bool:
    """Whether some piece left out could take the place of a part of the filling, or be added.

    That is so if the part, which may be empty, is no larger than the piece, and the piece exceeds
    it by no more than the waste; the part's pieces then fit wherever the piece would have gone. A
    single piece of the same size gains nothing. Sets of sizes are the bits of a number, so
    that all parts are looked at together; ``left`` has the sizes of the pieces left out.
    """
    one, other = 0, 1  # the sums of parts of one piece, and of none or several
    for s in filling:
        other |= (other & ~1 | one) << s
        one |= 1 << s

    def up(sums: int, most: int) -> int:
        """The sums with 0..most added."""
        done = 0
        while done < most:
            step = min(done + 1, most - done)
            sums |= sums << step
            done += step
        return sums

    near = up(other, waste)
    if waste:
        near |= up(one << 1, waste - 1)
    return bool(near & left & ~1)


def fillings(sizes: list[int], room: int, spare: int, steps: list[int]) -> Iterator[tuple[tuple[int, ...], list[int], int]]:
    """(filling, sizes left, waste) for the undominated fillings of ``room``; sizes are ascending.

    The waste is at most ``spare``. Larger pieces come first; equal pieces are tried once.
    ``steps`` holds the branches still allowed and is counted down.
    """
    sums = [0, *accumulate(sizes)]
    taken: list[int] = []
    stack = [[min(len(sizes), bisect_right(sizes, room)) - 1, room]]  # of each branch: the next piece to try, what is free
    while stack:
        at, free = stack[-1]
        if at >= 0 and steps[0] > 0 and sums[at + 1] >= free - spare:  # else what is left cannot fill it
            steps[0] -= 1
            size = sizes[at]
            stack[-1][0] = bisect_left(sizes, size) - 1
            taken.append(size)
            stack.append([min(at, bisect_right(sizes, free - size)) - 1, free - size])
            continue
        stack.pop()
        if free <= spare:
            left = list(sizes)
            for s in taken:
                left.pop(bisect_left(left, s))
            bits = 0
            for s in set(left):
                bits |= 1 << s
            if not dominated(tuple(taken), bits, free):
                yield tuple(taken), left, free
        if taken:
            taken.pop()


def solved(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> tuple[list[list[int]], str]:
    """Pack sizes, all in 1..capacity, into few bins, with nodes enough into the fewest; and the proof."""
    best, whole, steps = best_fit(sizes, capacity), sorted(sizes), [nodes]
    bound = -(-sum(sizes) // capacity)
    while len(best) > bound:
        allowed = (len(best) - 1) * capacity - sum(sizes)
        bins: list[list[int]] = []
        # of each open bin: the fillings to try, its largest piece, the waste of the bins before it
        stack = [(fillings(whole[:-1], capacity - whole[-1], allowed, steps), whole[-1], 0)]
        while stack:
            tries, largest, lost = stack[-1]
            del bins[len(stack) - 1 :]
            taken, left, waste = next(tries, (None, [], 0)) if steps[0] > 0 else (None, [], 0)
            if taken is None:
                stack.pop()
                continue
            bins.append([largest, *taken])
            if not left:
                break
            lost += waste
            stack.append((fillings(left[:-1], capacity - left[-1], allowed - lost, steps), left[-1], lost))
        if not stack:  # no better packing, or no branches left
            return best, "search" if steps[0] > 0 else "budget"
        best = bins
    return best, "bound"


def complete(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    return solved(sizes, capacity, nodes)[0]


OUTPUT = "bin_id long, place int, doc_id long, piece int, start int, n_tokens int, proof string"


def _packed(capacity: int, nodes: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece", "copy"], ascending=[False, True, True, True], ignore_index=True)
        sizes = rows["n_tokens"].tolist()
        full = sum(s == capacity for s in sizes)  # these come first, each a bin of its own
        by: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, full - 1, -1):
            by.setdefault(sizes[i], []).append(i)
        bins, proof = solved(sizes[full:], capacity, nodes)
        order, number, place = list(range(full)), list(range(full)), [0] * full
        for b, bin_ in enumerate(bins, full):
            for k, s in enumerate(bin_):
                order.append(by[s].pop())
                number.append(b)
                place.append(k)
        out = rows.loc[order, ["doc_id", "piece", "start", "n_tokens"]]
        out = out.assign(bin_id=[(int(key[0]) << 32) + b for b in number], place=place, proof=proof)
        return out[[c.split()[0] for c in OUTPUT.split(", ")]]

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """(bin_id, place, doc_id, piece, start, n_tokens, proof): where each piece of each document goes.

    A token is a run of characters other than white space. A document of more than ``capacity``
    tokens is cut into pieces from ``start`` on, full ones first; each full piece is a bin of its
    own. The same rows get the same bins in every run. Defined cases: null texts and texts without
    tokens take no place; a null ``doc_id`` is packed like any other; repeated rows are each packed,
    counted first so that they are dealt to all groups; an empty table gives an empty result; other
    columns play no part.
    """
    tokens = F.regexp_count("text", F.lit(r"\S+"))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokens.alias("n")).where("n > 0")
    lengths = stored(counted.groupBy("doc_id", "n").agg(F.count("*").alias("times")), "lengths")
    total = lengths.agg(F.sum(F.ceil(F.col("n") / capacity) * F.col("times"))).first()[0] or 0
    pieces = lengths.select("doc_id", "n", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "copy", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("n_tokens"))
    groups = max(1, -(-total // group))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy"), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(_packed(capacity, nodes), OUTPUT)
