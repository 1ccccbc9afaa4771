"""The driver contract, and the SQL of the queries on the smallest tables."""

import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from glyphmill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == columns
    rows = sorted(([plain(r[at[c]]) for c in columns] for r in want.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr) == rows


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_without_the_training_data_operators(tmp_path):
    """With the subpackage and the pipeline gone, the contract still imports and has the other queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "glyphmill"), tmp_path / "glyphmill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.catalogue.QUERIES), any(q.startswith('op') for q in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True", "False"], out.stderr
