"""Documents for the tests: awkward rows, and a table with extra columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("g", "k", "distance", "x0", "m0", "pos", "hash", "first", "rep", "a", "b", "_key", "_gone", "kept", "band", "part", "row", "_row", "sig", "fp", "kinds", "_redacted", "path", "n")


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    r = random.Random(7)
    long_text = "\n".join(words(r, 40) for _ in range(600))
    return [
        (1, words(r, 50), "en", "s", 1),
        (2, None, "en", "s", None),
        (3, "", "en", None, 0),
        (4, "   \n \t\n", None, "s", 7),
        (None, words(r, 30), "en", "s", 2),
        (None, None, None, None, None),
        (5, long_text, "en", "s", len(long_text)),
        (6, "x" * 50_000, "en", "s", 50_000),
        (7, words(r, 20), "en", "s", 3),
        (7, words(r, 20), "en", "s", 3),
        (8, "one", "en", "s", 3),
        (8, "one", "en", "s", 3),
        (9, "tie", "en", "s", 3),
        (10, "Tie", "en", "s", 3),
        (11, "line\r\nwith é中\U0001f600 and ​ signs\n\n\nend", "en", "s", 4),
    ]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in CLASHING:
            df = df.withColumn(name, F.lit(name))
    return df


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
