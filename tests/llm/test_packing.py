import random
from collections import Counter

from glyphmill.llm import packing as P

from .helpers import awkward, table


def fewest(sizes, capacity):
    """The least number of bins by exhaustive search."""
    best, sizes = [len(sizes)], sorted(sizes, reverse=True)

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


def test_small_groups_get_the_fewest_bins():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([12, 20, 50, 100])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        bins = P.complete(sizes, capacity)
        assert Counter(x for b in bins for x in b) == Counter(sizes)
        assert all(sum(b) <= capacity for b in bins)
        assert len(bins) == fewest(sizes, capacity)


def test_search_beats_best_fit_where_best_fit_fails():
    sizes = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]  # best-fit decreasing needs one bin more than the optimum
    r, found = random.Random(2), 0
    for _ in range(20000):
        sizes = [r.randint(10, 60) for _ in range(9)]
        if len(P.best_fit(sizes, 100)) > fewest(sizes, 100):
            found += 1
            assert len(P.complete(sizes, 100)) == fewest(sizes, 100)
            if found == 5:
                break
    assert found == 5


def bits(sizes):
    return sum(1 << s for s in set(sizes))


def test_domination():
    assert P.dominated((5, 3), bits([8]), 0)  # 8 for 5 + 3
    assert P.dominated((4,), bits([5]), 1)
    assert not P.dominated((4,), bits([6]), 1)
    assert not P.dominated((4,), bits([4]), 0)  # an equal piece gains nothing
    assert P.dominated((), bits([2]), 3)


def test_domination_equals_all_parts():
    from itertools import combinations

    r = random.Random(7)
    for _ in range(3000):
        filling = tuple(r.randint(1, 12) for _ in range(r.randint(0, 6)))
        left, waste = [r.randint(1, 30) for _ in range(r.randint(0, 4))], r.randint(0, 5)
        want = any(sum(part) <= s <= sum(part) + waste and (k != 1 or s > part[0]) for k in range(len(filling) + 1) for part in combinations(filling, k) for s in left)
        assert P.dominated(filling, bits(left), waste) == want


def test_bins_of_many_pieces():
    """Best fit needs two bins for these, of which one filling has twelve pieces."""
    sizes = [50, 30, 20, *[10] * 8, *[5] * 4]
    assert len(P.complete(sizes, 100)) == -(-sum(sizes) // 100) == 2
    r, better = random.Random(9), 0
    for _ in range(40):
        # twenty bins filled to the brim with about a dozen pieces each
        sizes = []
        for _ in range(20):
            cuts = sorted(r.sample(range(1, 200), 11))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 200], strict=True)]
        bins, proof = P.solved(sizes, 200)
        assert Counter(x for b in bins for x in b) == Counter(sizes) and max(map(sum, bins)) <= 200
        assert proof == ("bound" if len(bins) == 20 else "budget")
        better += len(bins) < len(P.best_fit(sizes, 200))
    ones = [1] * 5000 + [2047] * 3
    assert P.solved(ones, 2048)[1] == "bound"


def test_proofs():
    assert P.solved([60, 60, 60], 100) == ([[60], [60], [60]], "search")
    assert P.solved([60, 40], 100)[1] == "bound"
    r = random.Random(3)
    assert P.solved([r.randint(20, 70) for _ in range(300)], 100, nodes=5)[1] == "budget"


def test_a_used_up_budget_keeps_the_incumbent():
    r = random.Random(3)
    sizes = [r.randint(1, 100) for _ in range(200)]
    bins = P.complete(sizes, 100, nodes=1)
    assert Counter(x for b in bins for x in b) == Counter(sizes)


def check(docs, out, capacity):
    lengths = Counter()
    for r in docs.collect():
        if r["text"] and r["text"].split():
            lengths[r["doc_id"], len(r["text"].split())] += 1
    placed, bins = Counter(), Counter()
    for r in out.collect():
        bins[r["bin_id"]] += r["n_tokens"]
        placed[r["doc_id"], r["start"], r["n_tokens"]] += 1
        assert r["start"] == r["piece"] * capacity
    assert max(bins.values(), default=0) <= capacity
    want = Counter()
    for (doc, n), times in lengths.items():
        for start in range(0, n, capacity):
            want[doc, start, min(capacity, n - start)] += times
    assert placed == want
    return bins


def test_pack_places_every_piece_once(spark):
    docs = table(spark, awkward(), extra=True)
    check(docs, P.pack(docs, capacity=64), 64)


def test_pack_many_groups(spark):
    r = random.Random(4)
    rows = [(i, "w " * min(400, int(r.lognormvariate(3, 1)) + 1), "en", "s", 1) for i in range(3000)]
    docs = table(spark, rows)
    bins = check(docs, P.pack(docs, capacity=100, group=500), 100)
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert len(bins) <= 1.05 * total / 100 + 7


def test_repeated_rows_are_dealt_to_all_groups_and_runs_agree(spark):
    rows = [(None, "a b c", "en", "s", 1)] * 400 + [(1, "w " * 60, "en", "s", 1)] * 400 + [(2, "w " * 100, "en", "s", 1)] * 5
    docs = table(spark, rows)
    first = P.pack(docs, capacity=100, group=100)
    check(docs, first, 100)
    groups = Counter(r["bin_id"] >> 32 for r in first.collect())
    assert len(groups) == 9 and max(groups.values()) < 200
    again = P.pack(docs.repartition(7), capacity=100, group=100)
    assert sorted(map(tuple, first.collect()), key=repr) == sorted(map(tuple, again.collect()), key=repr)


def test_pack_empty(spark):
    assert P.pack(table(spark, [])).count() == 0
