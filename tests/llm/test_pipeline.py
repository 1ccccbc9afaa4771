"""The pipeline stage by stage: each against plain Python on what the stage before it kept."""

import os
import random
from collections import Counter

import corpus_pipeline as C
from glyphmill.llm import common, outliers, packing, pii

from .helpers import CLASHING, awkward, table, words
from .test_line_dedup import naive as naive_lines
from .test_minhash import naive as naive_copies

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def corpus():
    """Awkward rows, prose, junk, exact and near copies, shared passages and personal data."""
    r = random.Random(12)
    rows, passage = awkward(), words(r, 60)
    for i in range(220):
        text = "\n".join(". ".join(words(r, r.randint(5, 12)).capitalize() for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 5)))
        if i % 9 == 0:
            text += "\n" + passage
        if i % 11 == 0:
            text += f" mail someone{i}@host.example.org or call +1 (826) 555-4081"
        if i % 13 == 0:
            text = " | ".join(words(r, 60).split())  # junk
        if i % 7 == 0 and i:
            w = rows[-3][1].split(" ")
            w[r.randrange(len(w))] += "x" * (i % 2)
            text = " ".join(w)
        rows.append((100 + i, text, ("en", "de")[i % 2], "s", len(text)))
    return rows


def content(df):
    return Counter((*(r[c] for c in COLUMNS),) for r in df.collect())


def test_stages(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(C, "forget", kept.append)  # else the tables are gone when they are compared
    rows = corpus()
    docs = table(spark, rows, extra=True)
    result = C.staged(spark, docs, "")
    assert len(kept) == 4
    tables = [docs, *kept, result]
    before = [content(x) for x in tables[:5]]
    assert all(set(docs.columns) == set(x.columns) >= set(CLASHING) for x in tables[:5])

    # quality rules: the rows of the documents that the estimates keep, unchanged
    good = {(r["doc_id"], r["lang"], r["source"]) for r in outliers.regular(docs).collect()}
    assert before[1] == Counter({x: n for x, n in before[0].items() if (x[0], x[2], x[3]) in good})
    junk = {100 + i for i in range(220) if i % 13 == 0 and i % 7}
    assert not junk & {x[0] for x in before[1]} and len(before[1]) > 0.8 * len(before[0])

    # line dedup: all runs of lines that an earlier document has, from all pairs
    given = list(before[1].elements())
    gone, want = naive_lines(given, 8), Counter()
    for d, t, g, s, n in given:
        if (d, t) in gone:
            t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])
            n = len(t)
            if not t.strip():
                continue
        want[d, t, g, s, n] += 1
    assert gone and before[2] == want

    # near-duplicates: one document of each group, from all pairs
    copies, _ = naive_copies(list(before[2].elements()), 0.5)
    left = {x[0] for x in before[3]}
    assert before[3] == Counter({x: n for x, n in before[2].items() if x[0] in left or x[0] is None})
    missing = {x[0] for x in before[2]} - left
    assert missing <= set(copies) and len(missing) >= 0.95 * len(copies) > 0

    # personal data: every text by itself
    want = Counter()
    for d, t, g, s, n in before[3].elements():
        changed, kinds = pii.redact(t) if t else (t, [])
        want[(d, changed, g, s, len(changed)) if kinds else (d, t, g, s, n)] += 1
    assert before[4] == want and not any("@host" in (x[1] or "") for x in before[4])

    # packing: every token of every document once, no bin over its capacity
    lengths, placed, bins = Counter(), Counter(), Counter()
    for d, t, *_ in before[4].elements():
        lengths[d] += len((t or "").split())
    for r in result.collect():
        placed[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]] += r["n_tokens"]
    assert placed == +lengths and max(bins.values()) <= packing.CAPACITY
    assert len(bins) <= 1.1 * sum(lengths.values()) / packing.CAPACITY + 1


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    folder = common.shared_dir(spark).removeprefix("file://") + "/glyphmill"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    rows = [x for x in corpus() if x[0] is not None and x[0] >= 280]
    out = C.staged(spark, table(spark, rows), "")
    new = set(os.listdir(folder)) - before
    assert len(new) == 1 and out.count() > 0 and next(iter(new)).startswith("stage-best_fit_packing")


def test_empty(spark):
    assert C.staged(spark, table(spark, []), "").count() == 0
