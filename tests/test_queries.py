"""Every query with SQL gives the SQL's rows; every query runs."""

import glob
import os

import duckdb
import pytest

from tessera.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    if name in ORACLES:
        want = con.sql(ORACLES[name])
        assert sorted(want.columns) == cols
        assert got == sorted(map(repr, want.select(*(f'"{c}"' for c in cols)).fetchall()))


def test_entry_without_llm(tmp_path):
    """The entry imports and has the other queries where the llm folders are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr
