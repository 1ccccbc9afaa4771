import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glyphmill.llm import outliers as O
from glyphmill.llm.common import flat

from .helpers import awkward, rows_of, table, words


def naive_counts(text):
    import unicodedata

    kinds = Counter()
    for c in text:
        k = unicodedata.category(c)
        kinds[O.SPACE if c in "\t\n\v\f\r" or k[0] == "Z" else O.STOP if c in ".,;:'’-" else O.UPPER if k in ("Lu", "Lt") else O.LETTER if k[0] in "LM" else O.DIGIT if k[0] == "N" else O.SYMBOL] += 1
    low = "".join(c.lower() if c.isascii() else c for c in text)
    split = lambda t: [w for w in __import__("re").split(r"[\t\n\v\f\r \x1c-\x1f]+", t) if w]
    w = split(low)
    lines = [tuple(split(x)) for x in low.split("\n") if split(x)]
    return [kinds[i] for i in range(6)] + [len(w), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(lines), len(lines) - len(set(lines))]


def test_counts():
    texts = [t for _, t, *_ in awkward() if t is not None] + ["A b b B.\nx\nx\n\nX", "ÀÉ 12 №½ ##", ""]
    data, at = flat(pa.array(texts))
    assert O.raw_counts(data, at).tolist() == [naive_counts(t) for t in texts]


def test_chi_square():
    for p, q, want in ((1, 0.95, 3.841459), (7, 0.975, 16.012764), (2, 0.5, 1.386294)):
        assert abs(O.chi_square(q, p) - want) < 1e-5


def fast_mcd(x, seed=0):
    """The reweighted estimate from the h nearest, by sorting, from many random subsets: the half of
    the points whose covariance has the least determinant that any start leads to."""
    r, (n, p) = np.random.default_rng(seed), x.shape
    h = min(n, (n + p + 1) // 2)

    def squared(mean, cov):
        z = x - mean
        return (z @ np.linalg.inv(cov) * z).sum(axis=1)

    best = None
    for _ in range(60):
        some = x[r.choice(n, p + 1, replace=False)]
        mean, cov = some.mean(axis=0), O.solid(np.cov(some.T, bias=True))
        det = np.inf
        while True:
            near = x[np.argsort(squared(mean, cov), kind="stable")[:h]]
            mean, cov = near.mean(axis=0), O.solid(np.cov(near.T, bias=True))
            now = np.linalg.slogdet(cov)[1]
            if now >= det - 1e-12:
                break
            det = now
        if best is None or det < best[0]:
            best = det, mean, cov
    det, mean, cov = best
    cov = O.solid(cov * np.sort(squared(mean, cov))[h - 1] / O.chi_square(0.5, p))
    near = x[squared(mean, cov) <= O.chi_square(0.975, p)]
    return det, near.mean(axis=0), O.solid(np.cov(near.T, bias=True))


def contaminated(seed, n=900, share=0.3):
    """Correlated normal points, a share of them replaced by a far cluster and by wide noise."""
    r = np.random.default_rng(seed)
    mix = r.normal(size=(O.P, O.P)) * 0.3 + np.eye(O.P)
    x = r.normal(size=(n, O.P)) @ mix * 0.4
    bad = r.random(n) < share
    x[bad] = np.where(r.random((bad.sum(), 1)) < 0.5, 6 + 0.3 * r.normal(size=(bad.sum(), O.P)), 8 * r.normal(size=(bad.sum(), O.P)))
    return x, bad


def test_estimates_are_those_of_random_starts():
    for seed in range(6):
        x, bad = contaminated(seed)
        _, mean, cov = fast_mcd(x)
        got, scatter = O.fit_points(x)
        sd = np.sqrt(np.diag(cov))
        assert np.abs((got - mean) / sd).max() < 0.1
        assert np.abs(scatter / np.outer(sd, sd) - cov / np.outer(sd, sd)).max() < 0.1
        cut = O.chi_square(1 - 1e-6, O.P)
        far = [((x - m) @ np.linalg.inv(c) * (x - m)).sum(axis=1) > cut for m, c in ((mean, cov), (got, scatter))]
        assert (far[0] == far[1]).mean() > 0.995 and not far[1][~bad].any() and far[1][bad].mean() > 0.95


def points_of(spark, groups):
    rows = [(f"l{g % 2}", f"s{g}", *map(float, v)) for g, x in enumerate(groups) for v in x]
    df = spark.createDataFrame(rows, "lang string, source string, " + O._doubles(O._X))
    return df.withColumns({"g0": O._key(0), "g1": O._key(1, F.col("lang")), "g2": O._key(2, F.col("lang"), F.col("source"))})


def test_aggregations_equal_one_task(spark, monkeypatch):
    groups = [contaminated(s, n)[0] for s, n in enumerate((400, 30, 5))]
    table_ = points_of(spark, groups)
    small = {r["g"]: r for r in O.fit(table_).collect()}
    monkeypatch.setattr(O, "BROADCAST_ROWS", 0)
    large = {r["g"]: r for r in O.fit(table_, 25).collect()}
    assert len(small) == len(large) == 6 and {r["n"] for r in small.values()} == {435, 405, 400, 30, 5}
    for g, r in small.items():
        assert np.allclose(r["mean"], large[g]["mean"], atol=1e-6) and np.allclose(r["cov"], large[g]["cov"], atol=1e-6)


def test_a_narrow_window_of_bins_changes_nothing(spark, monkeypatch):
    table_ = points_of(spark, [contaminated(3, 500)[0]])
    want = {r["g"]: r["mean"] for r in O.fit(table_).collect()}
    monkeypatch.setattr(O, "NEAR", 1)
    got = {r["g"]: r["mean"] for r in O.fit(table_, 10).collect()}
    assert all(np.allclose(want[g], got[g], atol=1e-6) for g in want)


def test_small_groups_follow_their_language(spark):
    x = np.random.default_rng(1).normal(size=(4000, O.P)) * 0.3
    groups = [x[:3000], x[3000:3900], x[3900:3910] + 0.2, x[3910:] + 3]
    own = {r["n"]: r for r in O.fit(points_of(spark, groups)).collect()}
    final = {r["n"]: np.array([r[m] for m in O._M]) for r in O.estimates(points_of(spark, groups)).collect()}
    for n, mean in final.items():
        narrow, wide = np.array(own[n]["mean"]), np.array(own[3010 if n in (3000, 10) else 990]["mean"])
        n_wide, n_all = (3010, 4000) if n in (3000, 10) else (990, 4000)
        top = (n_all * np.array(own[n_all]["mean"]) + O.P * np.array(own[n_all]["mean"])) / (n_all + O.P)
        middle = (n_wide * wide + O.PRIOR * top) / (n_wide + O.PRIOR)
        assert np.allclose(mean, (n * narrow + O.PRIOR * middle) / (n + O.PRIOR))


def junk(r, kind):
    w = words(r, 60)
    return {"symbols": " | ".join(w.split()), "caps": w.upper() + "!!", "stutter": "same " * 60, "noise": " ".join(x + "&&&" for x in w.split())}[kind]


def corpus(n=400):
    r = random.Random(4)
    rows, bad = awkward(), set()
    for i in range(2 * n):
        lang = "en" if i % 2 else "de"
        source = "big" if i % 3 else f"small{i % 5}"
        text = ". ".join(words(r, r.randint(5, 12)).capitalize() for _ in range(r.randint(2, 12)))
        if r.random() < 0.08:
            text = junk(r, r.choice(["symbols", "caps", "stutter", "noise"]))
            bad.add(100 + i)
        rows.append((100 + i, text, lang, source, len(text)))
    return rows, bad


def test_junk_goes_and_the_rest_stays(spark):
    rows, bad = corpus()
    docs = table(spark, rows, extra=True)
    kept = {r["doc_id"] for r in O.regular(docs).collect()}
    good = {d for d, *_ in rows if d is not None and d >= 100} - bad
    assert good <= kept
    assert len(bad & kept) <= 0.05 * len(bad)
    out = O.keep_regular(docs)
    assert out.columns == docs.columns
    assert rows_of(out, "doc_id", "text", "n_chars") == sorted(((d, t, n) for d, t, _, _, n in rows if d in kept or d is None), key=repr)


def test_every_document_with_a_vector_is_judged(spark):
    r = random.Random(6)
    rows, bad = [], set()
    for i in range(760):
        lang, source = ("en", "a") if i < 300 else ("en", "new") if i < 340 else ("de", "a") if i < 750 else ("xx", "b")
        text = ". ".join(words(r, r.randint(5, 12)).capitalize() for _ in range(r.randint(2, 12)))
        if source == "new" and i % 4 == 0 or lang == "xx" and i % 4 == 3:
            text = junk(r, ("symbols", "caps", "stutter", "noise")[i // 2 % 4])
            bad.add(i)
        rows.append((i, text, lang, source, len(text)))
    for local in (O.LOCAL, 100):
        out = O.regular(table(spark, rows), local=local).collect()
        assert {x["doc_id"] for x in out} == set(range(760)) - bad
        assert all(x["distance"] is not None for x in out)


def test_small_and_odd_groups(spark):
    out = O.regular(table(spark, awkward()))
    kept = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert kept == sorted((d for d, *_ in awkward() if d != 6), key=repr)  # 6 is a word of 50,000 letters
    assert out.where("distance is null").count() == sum(not (t or "").strip() for _, t, *_ in awkward())
    same = [(i, "the very same text", None, None, 1) for i in range(300)] + [(999, "&&& ### *** $$$ %%% " * 40, None, None, 1)]
    kept = {r["doc_id"] for r in O.regular(table(spark, same)).collect()}
    assert kept == set(range(300))
    assert O.regular(table(spark, [])).count() == 0 and O.keep_regular(table(spark, [])).count() == 0
