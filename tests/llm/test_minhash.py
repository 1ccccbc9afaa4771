import random
from collections import defaultdict
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from glyphmill.llm import minhash as M
from glyphmill.llm.common import flat

from .helpers import CLASHING, awkward, rows_of, table, words


def shingle_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def naive(rows, threshold):
    """(doc_id, kept_id) by comparing all pairs of documents of one text."""
    sets = defaultdict(list)
    texts = defaultdict(list)
    for d, t, *_ in rows:
        if d is not None and t is not None and t.split() and d != 7:  # 7 has two texts, both like no other
            sets[d].append(shingle_set(t))
            texts[t].append(d)
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)

    pairs = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                pairs.add((a, b))
                join(a, b)
    for same in texts.values():
        for d in same:
            join(same[0], d)
    return {d: find(d) for d in ids if find(d) != d}, pairs


def corpus():
    r = random.Random(3)
    rows = awkward()
    for i in range(120):
        rows.append((100 + i, words(r, r.choice([8, 40, 120])), "en", "s", 1))
    for i in range(150):
        w = rows[15 + r.randrange(120)][1].split()
        for _ in range(int(len(w) * r.choice([0, 0.02, 0.05, 0.08, 0.2]))):
            w[r.randrange(len(w))] = words(r, 1)
        rows.append((300 + i, " ".join(w), "en", "s", 1))
    base = words(r, 200)
    for i in range(60):  # a large group of slightly different copies, and exact ones
        w = base.split()
        w[i * 3] = "changed"
        rows.append((1000 + i, " ".join(w), "de", "s", 1))
        rows.append((2000 + i, base, "de", "s", 1))
    return rows


def test_shingles_are_sets_of_trigrams():
    texts = ["a b c d", "A  b\nc", "x y", "x", "", None, "a b c d a b c d", "é b c", "É b c"]
    data, at = flat(pa.array(texts))
    h, bounds = M.shingles(data, at)
    sets = [set(h[bounds[i] : bounds[i + 1]].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [len(shingle_set(t or "")) for t in texts]
    assert sets[1] < sets[0] and sets[0] < sets[6]
    assert sets[7] != sets[8]  # only ASCII letters lose their case


def test_posterior_bounds():
    # the tail of Beta(m + 1, n - m + 1) by integrating the density
    least = M.least_matches(0.5, 0.01)
    x = np.linspace(0, 1, 200001)
    for k, m in enumerate(least):
        n = (k + 1) * M.BATCH

        def tail(j, n=n):
            density = (n + 1) * float(comb(n, j)) * x**j * (1 - x) ** (n - j)
            return np.trapezoid(density[100000:], x[100000:])

        assert tail(m) >= 0.01 > tail(m - 1)


def test_missed_by_pruning_is_rare():
    r = np.random.default_rng(1)
    for similarity in (0.5, 0.6, 0.9):
        a = r.integers(0, 65536, (4000, M.HASHES)).astype(np.uint16)
        b = np.where(r.random(a.shape) < similarity, a, a + np.uint16(1))
        assert M.survives(a, b, 0.5, M.MISS).mean() > 0.94
    b = np.where(r.random(a.shape) < 0.2, a, a + np.uint16(1))
    assert M.survives(a, b, 0.5, M.MISS).mean() < 0.01


def test_signatures_estimate_similarity():
    r = random.Random(5)
    w = words(r, 600).split()
    texts = [" ".join(w), " ".join(w[:400] + words(r, 200).split())]
    data, at = flat(pa.array(texts))
    h, bounds = M.shingles(data, at)
    a, b = (set(h[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
    same = (M.signature(h[: bounds[1]]) == M.signature(h[bounds[1] :])).mean()
    assert abs(same - len(a & b) / len(a | b)) < 0.12


def test_equals_all_pairs(spark):
    rows = corpus()
    want, pairs = naive(rows, M.THRESHOLD)
    got = {r["doc_id"]: r["kept_id"] for r in M.near_duplicates(table(spark, rows, extra=True)).collect()}
    linked = sum(got.get(a, a) == got.get(b, b) for a, b in pairs)
    assert linked >= 0.98 * len(pairs)
    assert all(want.get(d, d) == want.get(k, k) for d, k in got.items())  # nothing linked that is not


def boilerplate(n, seed=1):
    """Texts that have half of their words in common, so that unrelated ones share bands, and near copies of some."""
    r = random.Random(seed)
    common = words(r, 40)
    rows = [(i, f"{words(r, 20)} {common} {words(r, 20)}", "en", "s", 1) for i in range(n)]
    for i in range(0, n, 10):
        w = rows[i][1].split()
        w[r.randrange(60, 80)] = "changed"
        rows.append((n + i, " ".join(w), "en", "s", 1))
    return rows


def test_large_buckets_of_unrelated_documents(spark, monkeypatch):
    rows = boilerplate(1500)
    seen = {}

    def spy(texts, roots, threshold, real=M.similar_pairs):
        out = real(texts, roots, threshold).cache()
        seen["documents"], seen["pairs"] = roots.count(), {tuple(x) for x in out.collect()}
        return out

    monkeypatch.setattr(M, "similar_pairs", spy)
    got = {r["doc_id"]: r["kept_id"] for r in M.near_duplicates(table(spark, rows)).collect()}
    assert {d: k for d, k in got.items() if d >= 1500} == {1500 + i: i for i in range(0, 1500, 10)} == got
    assert seen["documents"] > 1200 and len(seen["pairs"]) < seen["documents"]  # of over a million


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_similar_pairs_are_all_pairs(spark, threshold, monkeypatch):
    rows = [x for x in corpus() if x[0] is not None and x[0] >= 100][:260] + boilerplate(60)
    r = random.Random(2)
    root = {d: r.choice((d, 5, 6)) for d, *_ in rows}
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    want = {(a, b) for a in sets for b in sets if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}
    texts, roots = table(spark, rows).select("doc_id", "text"), spark.createDataFrame(list(root.items()), "doc_id long, root long")
    for heaviest in (M.HEAVIEST, 3):
        monkeypatch.setattr(M, "HEAVIEST", heaviest)
        got = {tuple(x) for x in M.similar_pairs(texts, roots, threshold).collect()}
        assert want <= got and all(root[a] != root[b] for a, b in got)
    assert len(want) > 20


def test_of_several_texts_of_a_document_one_counts(spark):
    r = random.Random(8)
    a, b = words(r, 60), words(r, 60)
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, b, "en", "s", 1)]
    stands = min((a, b), key=lambda t: spark.range(1).selectExpr(f"xxhash64('{t}') as h").first()["h"])
    got = {r["doc_id"]: r["kept_id"] for r in M.near_duplicates(table(spark, rows)).collect()}
    assert got == ({2: 1} if stands == a else {3: 2})


def test_buckets_that_stay_apart_lose_no_link(spark, monkeypatch):
    rows = corpus()
    want = sorted(map(tuple, M.near_duplicates(table(spark, rows)).collect()))
    monkeypatch.setattr(M, "SMALL", 1)
    assert sorted(map(tuple, M.near_duplicates(table(spark, rows)).collect())) == want


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = corpus()
    docs = table(spark, rows, extra=True)
    gone = {r["doc_id"] for r in M.near_duplicates(docs).collect()}
    out = M.deduplicated(docs)
    assert out.columns == docs.columns and set(CLASHING) <= set(out.columns)
    assert rows_of(out, "doc_id", "text") == sorted(((d, t) for d, t, *_ in rows if d not in gone), key=repr)
    assert {8, 1000} <= {d for d, *_ in rows} - gone and 2000 in gone and 10 in gone


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(r.randrange(300, 500), r.randrange(300, 500)) for _ in range(150)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(map(tuple, M.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), *[(None, "a b c d", "en", "s", 1)] * 3, (1, "", "en", "s", 1), (2, "", "en", "s", 1)]])
def test_nothing_to_compare(spark, rows):
    assert M.near_duplicates(table(spark, rows)).count() == 0
    assert M.deduplicated(table(spark, rows)).count() == len(rows)
