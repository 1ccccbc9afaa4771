"""MinHash near-duplicates, verified sequentially by posterior bounds and then exactly.

Signatures of ``HASHES`` 16-bit minima over word trigrams are cut into bands; documents that
agree on a band are candidates. A candidate pair's signatures are compared in batches: after each
batch the posterior of the similarity, given the matches so far and a uniform prior, tells how
probable a similarity of at least the threshold still is, and the pair is dropped once that is
under the chosen miss probability. Survivors are verified on their whole sets of trigrams.

Big buckets cost no square of pairs, and no bucket is gathered in one row or task. Each bucket's
members are first held against its smallest document only, and the links found make groups. A
pair inside a group cannot change the groups, so only pairs across the groups of a bucket are left:

* in buckets of up to ``SMALL`` documents, all of them;
* in larger ones, those that can reach the threshold at all, by an exact set-similarity join over
  their documents: trigrams in one order for all, those in many documents last; the shorter document's first
  |y| - 2t/(1 + t)|y| + 1 and the longer one's first |x| - t|x| + 1 trigrams must meet, at places that
  leave enough for the overlap that is needed. Trigrams that only one group has are left out.

So no link between documents of a bucket is lost, and unrelated documents that share boilerplate
meet in no pair unless it is most of their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import attached, forget, fresh, mix, slices, small_batches, stored, token_hashes

BANDS, ROWS = 40, 4
HASHES = BANDS * ROWS
SHINGLE = 3
THRESHOLD = 0.5
MISS = 0.01
BATCH = 32
SMALL = 32  # documents of a bucket whose pairs across groups are all made
HEAVY, HEAVIEST = 16, 1_000_000  # trigrams of more documents come last; so many of them in the order of their numbers
PART = 2000  # comparisons with one document that a task makes in a row
BROADCAST_IDS = 1_000_000  # of the documents to verify; of more, the texts are found by a shuffle

_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word trigrams of a run of texts and each row's bounds among them.

    A text of one or two words has them as its only shingle; a text without words has none.
    """
    words, _, bounds = token_hashes(data, at)
    n = np.diff(bounds)
    count = np.where(n == 0, 0, np.maximum(1, n - SHINGLE + 1))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    row = np.repeat(np.arange(len(n)), count)
    begin = bounds[:-1][row] + np.arange(out[-1]) - out[:-1][row]
    padded, end = np.append(words, np.zeros(SHINGLE, np.uint64)), bounds[1:][row]
    total = np.zeros(len(begin), np.uint64)
    for k in range(SHINGLE):
        total += np.where(begin + k < end, padded[begin + k], np.uint64(0)) * _C[k]
    return mix(total), out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima of all hash functions over a set of shingles."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), 1024):
        np.minimum(least, (short[None, i : i + 1024] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint32(8)).astype(np.uint16)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs, bands = [], []
        for _, data, at in slices(batch.column("text")):
            hashes, bounds = shingles(data, at)
            for i in range(len(bounds) - 1):
                if bounds[i] == bounds[i + 1]:
                    sigs.append(None)
                    continue
                sigs.append(signature(hashes[bounds[i] : bounds[i + 1]]).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "fp", "h")), pa.array(sigs, pa.binary())], ["doc_id", "fp", "h", "sig"])


@lru_cache(maxsize=None)
def least_matches(threshold: float, miss: float, hashes: int = HASHES, batch: int = BATCH) -> tuple[int, ...]:
    """For each batch end n, the fewest matches m with P(similarity >= threshold | m of n) >= miss.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is the
    binomial sum of C(n + 1, i) t^i (1 - t)^(n + 1 - i) over i = 0..m.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Which pairs of signature rows pass all sequential tests; later batches see survivors only."""
    alive, matched = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matched[alive] += (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[matched[alive] >= least]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _bayes(threshold: float, miss: float):
    @F.pandas_udf(BooleanType())
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, HASHES)
        y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, HASHES)
        return pd.Series(survives(x, y, threshold, miss))

    return test


def _verified(threshold: float):
    """Rows come sorted by (a, part), the text of a itself first; only that one set is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            found: list[tuple[int, int, float]] = []
            for first, data, at in slices(batch.column("text")):
                hashes, bounds = shingles(data, at)
                for i in range(len(bounds) - 1):
                    row, other = first + i, np.unique(hashes[bounds[i] : bounds[i + 1]])
                    if b[row] is None:
                        key, own = (a[row], part[row]), other
                    elif key == (a[row], part[row]):
                        common = len(np.intersect1d(own, other, assume_unique=True))
                        similarity = common / max(1, len(own) + len(other) - common)
                        if similarity >= threshold:
                            found.append((a[row], b[row], similarity))
            columns = list(zip(*found, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["a", "b", "similarity"])

    return run


def _texts(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in a stored table of ids, each once."""
    return base.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def verify(pairs: DataFrame, sigs: DataFrame, base: DataFrame, threshold: float, miss: float) -> DataFrame:
    """The pairs (a, b) whose trigram sets have a Jaccard similarity of at least the threshold.

    ``sigs`` has one row a document, ``base`` the texts of all. Only the texts of pairs that survive the
    signatures move: their ids are broadcast to the scan up to ``BROADCAST_IDS``. A document with
    many partners has them cut into parts, each with its own copy of that document, so that no
    task holds them all.
    """
    left, right = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    passed = stored(pairs.join(left, "a").join(right, "b").where(_bayes(threshold, miss)("sa", "sb")).select("a", "b"), "passed")
    if passed.isEmpty():
        return passed.withColumn("similarity", F.lit(0.0))
    size = passed.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    alive = stored(passed.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")), "alive")
    ids = stored(alive.select(F.col("a").alias("doc_id")).unionByName(alive.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    texts = _texts(base, ids)
    wanted = alive.select(F.col("b").alias("doc_id"), "a", "part", "b").unionByName(
        alive.select("a", "part").distinct().select(F.col("a").alias("doc_id"), "a", "part", F.lit(None).cast("long").alias("b"))
    )
    rows = wanted.join(texts, "doc_id").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verified(threshold), "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of an edge table (a, b); the root is the component's least node.

    Alternates the large-star and small-star steps, each written to the shared folder, until the
    edges stand still; the number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = attached(both.where("v > u"), stored(least, "least"), "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, edges = edges, stored(small, "edges")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct trigrams of each text."""
    for batch in batches:
        for first, data, at in slices(batch.column("text")):
            hashes, bounds = shingles(data, at)
            found = [np.unique(hashes[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(len(bounds) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(found)), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "tokens"])


def _prefixes(threshold: float, heavy: tuple[np.ndarray, np.ndarray]):
    """(token, doc_id, size, place, short) of the first tokens of each set; ``heavy`` has the tokens that
    come last, sorted, and their order. ``short`` marks those that count if the set is the smaller one."""
    names, order = heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, given in zip(batch.column("doc_id").to_pylist(), batch.column("tokens"), strict=True):
                tokens = given.values.to_numpy()
                at = np.minimum(np.searchsorted(names, tokens), max(0, len(names) - 1))
                rank = np.where(names[at] == tokens, order[at], -1) if len(names) else np.full(len(tokens), -1)
                tokens, n = tokens[np.lexsort((tokens, rank))], len(tokens)
                most = n - int(np.ceil(round(threshold * n, 9))) + 1
                least = n - int(np.ceil(round(2 * threshold / (1 + threshold) * n, 9))) + 1
                place = np.arange(most)
                rows.append((tokens[:most], np.full(most, doc), np.full(most, n), place, place < least))
            columns = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["token", "doc_id", "size", "place", "short"])

    return run


def similar_pairs(texts: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) across groups, among them all whose trigram sets have a similarity of at least the threshold.

    ``texts`` (doc_id, text) and ``roots`` (doc_id, root) have one row a document. Any order of the
    trigrams gives all such pairs; the order by frequency keeps those that cannot be apart.
    """
    sets = stored(texts.mapInArrow(_sets, "doc_id long, tokens array<long>"), "sets")
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") > HEAVY)
    rows = counts.orderBy(F.desc("count"), "token").limit(HEAVIEST).collect()
    tokens, number = (np.array([r[c] for r in rows], np.int64) for c in ("token", "count"))
    by = np.argsort(tokens)
    made = sets.mapInArrow(_prefixes(threshold, (tokens[by], number[by])), "token long, doc_id long, size int, place int, short boolean")
    postings = stored(made.join(roots, "doc_id"), "postings")
    several = stored(postings.groupBy("token").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("token", "n"), "several")
    shared = stored(attached(postings, several, "token", "n").drop("n"), "shared")
    x, y = (shared.where(w).select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "size", "place", "root")]) for k, w in (("x", "true"), ("y", "short")))
    needed = F.expr(f"ceil(round({threshold / (1 + threshold)!r} * (size_x + size_y), 9))")
    fits = F.least(F.expr("size_x - place_x"), F.expr("size_y - place_y")) >= needed
    found = x.join(y, "token").where("root_x <> root_y and (size_y < size_x or size_y = size_x and doc_id_y < doc_id_x)").where(F.expr("size_y") >= F.expr(f"round({threshold!r} * size_x, 9)")).where(fits)
    return found.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, kept_id) for each document that is a near or exact copy of a kept one.

    Copies are those linked by pairs with a trigram Jaccard similarity of at least ``threshold``,
    directly or through others; each group keeps its smallest ``doc_id``. Defined cases: a null
    ``doc_id``, and a null text or one without words, is nobody's copy; words are compared without
    regard to ASCII case and white space; rows of a ``doc_id`` are one document, for which that of its
    texts stands whose ``xxhash64`` is the smallest; equal texts are copies whatever their length; an
    empty table gives an empty result; other columns play no part.
    """
    small_batches(docs.sparkSession)
    base = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("fp"), F.xxhash64("text").alias("h"), "text")
    features = stored(base.mapInArrow(_signatures, "doc_id long, fp binary, h long, sig binary").where("sig is not null"), "features")
    # documents of several texts: one of them counts, here and where texts are read again
    several = stored(features.groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("doc_id", "lo"), "several")
    if not several.isEmpty():
        features, base = (t.join(several, "doc_id", "left").where("lo is null or h = lo").drop("lo") for t in (features, base))
    base = base.select("doc_id", "text")

    copies = stored(features.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "copies")
    sigs = stored(features.join(copies.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi").select(F.col("doc_id").alias("rep"), "sig").dropDuplicates(["rep"]), "sigs")

    width = 2 * ROWS
    bands = sigs.select("rep", F.explode(F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + k * width, width)) for k in range(BANDS)])).alias("band"))
    heads = stored(bands.groupBy("band").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"), "heads")
    members = stored(attached(bands, heads, "band", "n"), "members")
    star = members.where("a < rep").select("a", F.col("rep").alias("b")).distinct()
    near_sigs = stored(sigs.join(members.select("rep").distinct(), "rep", "left_semi"), "near_sigs")
    first = stored(verify(star, near_sigs, base, threshold, miss).select("a", "b"), "star")

    groups = components(first)
    rooted = members.select("band", "n", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    rooted = stored(rooted, "rooted")
    apart = stored(rooted.groupBy("band", "n").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "n"), "apart")
    few = rooted.where(F.col("n") <= SMALL).join(apart.select("band"), "band", "left_semi").drop("n")
    x, y = few.select("band", F.col("rep").alias("a"), F.col("root").alias("ra")), few.select("band", F.col("rep").alias("b"), F.col("root").alias("rb"))
    cross = x.join(y, "band").where("ra <> rb and a < b").select("a", "b")
    many = stored(attached(rooted.where(F.col("n") > SMALL).drop("n"), apart.where(F.col("n") > SMALL), "band", "n").select(F.col("rep").alias("doc_id"), "root").distinct(), "many")
    if not many.isEmpty():
        cross = cross.unionByName(similar_pairs(_texts(base, many.select("doc_id")), many, threshold))
    cross = cross.distinct().join(star.withColumn("done", F.lit(1)), ["a", "b"], "left_anti")
    second = verify(cross, near_sigs, base, threshold, miss).select("a", "b")
    # the groups made so far go on as stars; copies of a text follow it and need no part in the rounds
    roots = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second))
    texts = copies.where("n > 1").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", "rep", F.coalesce("root", "rep").alias("kept_id"))
    exact = attached(features.select("doc_id", "fp"), stored(texts, "texts"), "fp", "n").where("doc_id <> rep").select("doc_id", "kept_id").distinct()
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("kept_id")).unionByName(exact)


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, miss: float = MISS) -> DataFrame:
    """The documents without those that :func:`near_duplicates` finds; columns stay as they are."""
    gone = fresh(docs.columns, "gone")
    drop = near_duplicates(docs, threshold, miss).select(F.col("doc_id").alias(gone))
    return docs.join(drop, docs["doc_id"] == drop[gone], "left_anti")
