import random

from glyphmill.llm import licenses as L

from .helpers import awkward, table


def naive(rows, templates, threshold):
    out = []
    for d, t, *_ in rows:
        sets = [L.tokens(x) for x in (t or "").split("\n")]
        blocks = [(i, 1, x) for i, x in enumerate(sets)]
        for i in range(len(sets)):
            for j in range(i + 2, len(sets) + 1):
                if all(sets[i:j]) and not (i and sets[i - 1]) and not (j < len(sets) and sets[j]):
                    blocks.append((i, j - i, set().union(*sets[i:j])))
        for i, lines, have in blocks:
            for name, text in templates.items():
                want = L.tokens(text)
                n = len(want & have)
                if n >= L.needed(len(want), threshold):
                    out.append((d, i, lines, name, len(want), n, n / len(want)))
    return sorted(out, key=repr)


def fixture():
    r = random.Random(5)
    lines = list(L.TEMPLATES.values())
    rows = awkward()
    for i in range(200):
        text = []
        for _ in range(r.randint(1, 6)):
            words = r.choice(lines).split()
            for _ in range(r.randint(0, 4)):
                words.pop(r.randrange(len(words))) if len(words) > 2 else None
            r.shuffle(words)
            words += ["noise%d" % r.randrange(9) for _ in range(r.randint(0, 5))]
            text.append(" ".join(words).upper() if r.random() < 0.3 else " ".join(words))
            if r.random() < 0.3:
                text[-1:] = [" * " + text[-1][k : k + 40] for k in range(0, len(text[-1]), 40)]
            if r.random() < 0.3:
                text.append(r.choice(("", "  ", "# ---")))
        rows.append((100 + i, "\n".join(text), "en", "s", 1))
    return rows + rows[-3:]


def test_equals_all_pairs(spark):
    rows = fixture()
    for threshold in (0.5, 0.8, 1.0):
        out = L.scan(table(spark, rows, extra=True), threshold=threshold)
        assert sorted(map(tuple, out.collect()), key=repr) == naive(rows, L.TEMPLATES, threshold)


def test_other_templates_and_empty(spark):
    rows = [(1, "alpha beta\ngamma", "en", "s", 1)]
    found = L.scan(table(spark, rows), {"t": "beta ALPHA", "one": "gamma"}).collect()
    assert sorted((r["block"], r["lines"], r["template"]) for r in found) == [(0, 1, "t"), (0, 2, "one"), (0, 2, "t"), (1, 1, "one")]
    assert L.scan(table(spark, [])).count() == 0


def test_counts_are_over_the_whole_corpus(spark):
    rows = fixture()
    want = {w: 0 for w in set().union(*map(L.tokens, L.TEMPLATES.values()))}
    import re

    for _, t, *_ in rows:
        for w in re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in t or "")):
            if w in want:
                want[w] += 1
    assert L.token_counts(table(spark, rows)) == want


def test_wrapped_notices(spark):
    import textwrap

    rows, want = [], set()
    for i, (name, text) in enumerate(L.TEMPLATES.items()):
        for k, (width, mark) in enumerate(((60, ""), (78, " * "), (74, "# "), (72, "// "))):
            body = "\n".join(mark + x for x in textwrap.wrap(text, width))
            rows.append((10 * i + k, f"Copyright somebody\n\n{body}\n{mark}\nint main", "en", "s", 1))
            want.add((10 * i + k, name))
    found = {(r["doc_id"], r["template"]) for r in L.scan(table(spark, rows)).where("block = 2").collect()}
    assert want <= found
