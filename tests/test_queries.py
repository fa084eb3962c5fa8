"""Every registered query against its SQL, on the smallest tables."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lattice.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=repr)
    want = sorted(db.execute(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want


def test_entry_imports_without_the_language_subpackage(tmp_path):
    repo = Path(__file__).parent.parent
    for p in ("lattice", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(repo / p), str(tmp_path / p)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lattice" / "llm")], check=False)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gemm_f64' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
