import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from glyphmill.llm import fingerprint as P

from .helpers import awkward, table


def naive(text):
    lanes = [0] * P.LANES
    for line in (text or "").split("\n"):
        line = line.strip(" \t\r\v\f")
        if line:
            digests = b"".join(hashlib.sha256(f"{i}:{line}".encode()).digest() for i in range(P.BLOCKS))
            for k in range(P.LANES):
                lanes[k] = (lanes[k] + int.from_bytes(digests[4 * k : 4 * k + 4], "big")) % (1 << 32)
    return "".join(f"{x:08x}" for x in lanes)


def test_equals_naive(spark):
    rows = awkward()
    out = P.fingerprints(table(spark, rows, extra=True)).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out) == Counter((d, naive(t)) for d, t, *_ in rows)
    assert {r["n_paragraphs"] for r in out if r["fingerprint"] == P.EMPTY} == {0}
    assert P.fingerprints(table(spark, [])).count() == 0


def test_order_insertion_and_deletion(spark):
    lines = [f"paragraph {i}" for i in range(20)] + ["twice", "twice"]
    mixed = random.Random(1).sample(lines, len(lines))
    rows = [(1, "\n".join(lines)), (2, "\n\n".join(mixed)), (3, "\n".join(lines[:-1])), (4, "twice"), (5, "\n".join(set(lines)))]
    f = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert f[1] == f[2] != f[3]
    assert f[5] == f[3]  # a repeated paragraph counts twice
    pair = spark.createDataFrame([(f[3], f[4], f[1], None)], "x string, y string, z string, n string")
    r = pair.select(P.added(F.col("x"), F.col("y")), P.removed(F.col("z"), F.col("y")), P.added(F.col("x"), F.col("n"))).first()
    assert list(r) == [f[1], f[3], None]
    groups = P.equal_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(g["doc_ids"] for g in groups) == [[1, 2], [3, 5]]


def test_total_is_that_of_all_paragraphs(spark):
    rows = [(i, f"a{i}\nb{i % 3}") for i in range(50)]
    total = P.total(P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))).first()["fingerprint"]
    assert total == naive("\n".join(t for _, t in rows))
    assert P.total(P.fingerprints(table(spark, []))).first()["fingerprint"] == P.EMPTY
