import random
from collections import Counter

import numpy as np

from glyphmill.llm import common
from glyphmill.llm import line_dedup as L

from .helpers import awkward, rows_of, table


def lis(values):
    best = [1] * len(values)
    for i in range(len(values)):
        for j in range(i):
            if values[j] < values[i]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_patience_properties():
    r = random.Random(1)
    for _ in range(1500):
        a = [r.randrange(12) for _ in range(r.randint(0, 14))]
        b = [r.randrange(12) for _ in range(r.randint(0, 14))]
        pairs = L.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:], strict=False))
        if a and b and a[0] != b[0] and a[-1] != b[-1]:  # no head or tail: as many anchors as fit in order, at least
            once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
            assert len(pairs) >= lis([b.index(x) for x in once])


def test_patience_example():
    assert L.patience([1, 2, 3, 9, 4, 5], [1, 2, 3, 4, 5]) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4)]
    assert L.patience([7, 1, 2, 8], [1, 2]) == [(1, 0), (2, 1)]
    assert L.patience([1, 2], [2, 1]) in ([(0, 1)], [(1, 0)])
    assert L.patience([], [1]) == []


def normal(line):
    return " ".join(line.split())


def in_common(later, words, earlier, least):
    """Positions of all common runs of enough words, by trying every pair of begins."""
    out = set()
    for i in range(len(later)):
        for j in range(len(earlier)):
            n = 0
            while i + n < len(later) and j + n < len(earlier) and later[i + n] == earlier[j + n]:
                n += 1
            if n and sum(words[i : i + n]) >= least:
                out |= set(range(i, i + n))
    return sorted(out)


def naive(rows, least):
    """Deleted positions by (doc_id, text), from all pairs of texts and all runs of their lines."""
    texts = {}
    for d, t, *_ in rows:
        if d is not None and t is not None:
            texts[d, t] = [(i, normal(x)) for i, x in enumerate(t.split("\n")) if normal(x)]
    out = {}
    for (d, t), lines in texts.items():
        own = [x for _, x in lines]
        gone = set()
        for (e, _), other in texts.items():
            theirs = [x for _, x in other]
            if e < d and not set(own).isdisjoint(theirs):
                gone.update(in_common(own, [len(x.split()) for x in own], theirs, least))
        if gone:
            out[d, t] = sorted(lines[i][0] for i in gone)
    return out


def found(spark, rows, rare=L.RARE, least=L.WORDS, extra=False):
    """What the operator deletes, by (doc_id, text)."""
    docs = table(spark, rows, extra=extra)
    texts = {r["fp"]: r["text"] for r in docs.where("text is not null").selectExpr("xxhash64(text) as fp", "text").collect()}
    rows = L.repeated_lines(docs, rare, least).collect()
    assert len({(r["doc_id"], r["fp"]) for r in rows}) == len(rows)
    return {(r["doc_id"], texts[r["fp"]]): r["positions"] for r in rows}


def corpus(n=80):
    r = random.Random(2)
    pool = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randint(1, 12))) for _ in range(60)]
    rows = awkward()
    for i in range(n):
        if r.random() < 0.2 and i:
            lines = rows[-1][1].split("\n")
            lines[r.randrange(len(lines))] = f"changed {i}"
        else:
            lines = [f"own {i} {k} " + "x " * r.randrange(10) for k in range(r.randint(1, 6))]
            at = r.randrange(len(pool) - 4)
            lines[r.randrange(len(lines)) : 0] = pool[at : at + r.randint(1, 4)]
            if r.random() < 0.5:
                lines += ["", "  a banner that is on very many of the documents here  "]
        rows.append((100 + i, "\n".join(lines), "en", "s", 1))
    return rows


def test_positions_equal_all_pairs(spark):
    rows = corpus() + [(7, corpus()[-1][1], "en", "s", 1), (179, "own\n" + corpus()[20][1], "en", "s", 1)]
    for least, rares in ((L.WORDS, (L.RARE, 3)), (1, (10, 1)), (20, (L.RARE,))):
        want = naive(rows, least)
        for rare in rares:
            assert found(spark, rows, rare, least, extra=True) == want


def test_texts(spark):
    rows = corpus()
    gone = naive(rows, L.WORDS)
    want = []
    for d, t, g, s, n in rows:
        if (d, t) in gone:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])
            n = len(t)
        want.append((d, t, g, s, n))
    docs = table(spark, rows, extra=True)
    out = L.deduplicate(docs)
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id", "text", "lang", "source", "n_chars") == sorted(want, key=repr)
    kept = L.deduplicate(docs, drop_empty=True, count="lost")
    left = {d for d, _ in gone}
    assert Counter(r["doc_id"] for r in kept.select("doc_id").collect()) == Counter(d for d, t, *_ in want if d not in left or t.strip())
    assert {r["doc_id"]: r["lost"] for r in kept.where("lost > 0").collect()} == {d: len(p) for (d, _), p in gone.items() if any(w[0] == d and w[1].strip() for w in want)}


def test_an_exact_copy_of_an_earlier_document_that_is_no_first_holder_of_a_line(spark):
    a, b = "four words are here", "another four are there"
    rows = [(1, a, "en", "s", 1), (2, b, "en", "s", 1), (3, f"{a}\n{b}", "en", "s", 1), (4, f"{a}\n{b}", "en", "s", 1)]
    for rare in (L.RARE, 1):
        assert found(spark, rows, rare) == {(4, rows[3][1]): [0, 1]}


def test_frequent_lines_of_different_documents_side_by_side_stay(spark):
    a, b = "four words are here", "another four are there"
    rows = [(i, f"{(a, b)[i % 2]}\nown {i}", "en", "s", 1) for i in range(60)] + [(100, f"{a}\n{b}", "en", "s", 1)]
    for rare in (L.RARE, 10):
        assert found(spark, rows, rare) == {}


def test_hot_anchors_are_joined_apart(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(common, "HOT", 4)
    assert found(spark, rows) == naive(rows, L.WORDS)
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert found(spark, rows) == naive(rows, L.WORDS)


def test_anchors_cover_all_runs_and_have_equal_hashes_for_equal_lines():
    r = random.Random(8)
    by_hash = {}
    for _ in range(400):
        sizes = [r.randint(0, 6) for _ in range(r.randint(1, 4))]
        weight = {x: r.randint(1, 9) for x in range(6)}
        texts = [[r.randrange(6) for _ in range(n)] for n in sizes]
        flat_ = [x for t in texts for x in t]
        bounds, least = np.cumsum([0, *sizes]), r.choice((1, 4, 8, 15))
        i, j, h = L.anchors(np.array(flat_, np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([weight[x] for x in flat_], np.int64), bounds, least)
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        total = lambda a, b: sum(weight[x] for x in flat_[a:b])
        runs = [(a, b) for lo, hi in zip(bounds, bounds[1:], strict=False) for a in range(lo, hi) for b in range(a + 1, hi + 1) if total(a, b) >= least]
        assert got == {(a, b) for a, b in runs if total(a, b - 1) < least or total(a + 1, b) < least}
        for a, b in runs:
            assert {x for p, q in got if a <= p and q <= b for x in range(p, q)} == set(range(a, b))
        for a, b, x in zip(i.tolist(), j.tolist(), h.tolist(), strict=True):
            assert by_hash.setdefault(x, tuple(flat_[a:b])) == tuple(flat_[a:b])


def test_the_first_copy_stays_and_short_lines_stay(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"start {i}\n{passage}\nown {i}\nYes.\nend {i}", "en", "s", 1) for i in range(1, 400)]
    out = {r["doc_id"]: r["text"] for r in L.deduplicate(table(spark, rows)).collect()}
    assert out[1] == rows[0][1]
    assert all(out[i] == f"start {i}\nown {i}\nYes.\nend {i}" for i in range(2, 400))


def test_a_short_line_beside_a_passage_is_part_of_its_block(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"start {i}\n{passage}\nYes.\nend {i}", "en", "s", 1) for i in range(1, 400)]
    want = {(i, t): [1, 2] for i, t, *_ in rows if i > 1}
    assert found(spark, rows) == found(spark, rows, 1000) == want


def test_blocks_are_all_common_runs():
    r = random.Random(3)
    for _ in range(3000):
        weight = [r.randint(1, 9) for _ in range(8)]
        a, b = ([r.randrange(8) for _ in range(r.randint(0, 16))] for _ in range(2))
        words, least = [weight[x] for x in a], r.choice((1, 4, 8, 15))
        assert L.blocks(a, words, b, least) == in_common(a, words, b, least)


def test_repeated_and_moved_blocks_go(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(12)) for x in "ab")
    texts = [f"start\n{one}\nmid\n{two}\n{one}\nend", f"own\n{one}\nrest", f"{two}\nkept\n{one}\n{two}\nlast", f"{one}\nx\n{one}\ny"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {d: p for (d, _), p in found(spark, rows).items()}
    assert got == {1: [1], 2: [0, 2, 3], 3: [0, 2]}


def test_every_later_copy_of_a_long_line_goes(spark):
    """By looking at all earlier documents, without alignments or first holders."""
    r = random.Random(4)
    pool = [" ".join(f"p{k}w{i}" for i in range(r.randint(1, 12))) for k in range(30)]
    rows = []
    for d in range(60):
        lines = [f"own {d} {k}" for k in range(4)] + [r.choice(pool) for _ in range(r.randint(0, 10))] + [""] * r.randrange(3)
        r.shuffle(lines)
        rows.append((d, "\n".join(lines), "en", "s", 1))
    kept = [[(i, normal(x)) for i, x in enumerate(t.split("\n")) if normal(x)] for _, t, *_ in rows]
    long, some = {}, {}
    for d, lines in enumerate(kept):
        own = [x for _, x in lines]
        before = [[x for _, x in kept[e]] for e in range(d)]
        long[d] = {i for i, x in lines if len(x.split()) >= L.WORDS and any(x in o for o in before)}
        some[d] = {lines[i][0] for o in before for i in in_common(own, [len(x.split()) for x in own], o, L.WORDS)}
    for rare in (L.RARE, 3):
        got = {x["doc_id"]: set(x["positions"]) for x in L.repeated_lines(table(spark, rows), rare).collect()}
        assert all(long[d] <= got.get(d, set()) for d in long)
        assert all(p <= some[d] for d, p in got.items())


def test_frequent_lines_are_neighbours_across_blank_lines(spark):
    rows = [(i, f"own {i}\nfour words of head\n\nfour words of foot\nend {i}", "en", "s", 1) for i in range(1, 9)]
    for rare in (L.RARE, 3):
        assert {d: p for (d, _), p in found(spark, rows, rare).items()} == {i: [1, 3] for i in range(2, 9)}


def test_empty(spark):
    assert L.deduplicate(table(spark, [])).count() == 0
    assert L.repeated_lines(table(spark, [])).count() == 0


def test_sql_equals_all_pairs():
    import duckdb
    import pandas as pd

    rows = [x for x in corpus() if x[0] is not None and x[0] >= 100]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    con = duckdb.connect()
    con.register("documents", documents)
    for least in (L.WORDS, 1, 20):
        gone = naive(rows, least)
        want = [(d, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, t), ())), len(gone.get((d, t), ()))) for d, t, *_ in rows]
        assert sorted(con.execute(L.deduplicate_sql(least)).fetchall()) == sorted(want)
