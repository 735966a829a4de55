"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from dossierlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def _cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    try:
        return f"{float(x):.5f}"
    except (TypeError, ValueError):
        return str(x)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in duck.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(_cell(r[c]) for c in order) for r in got.collect())
    theirs = sorted(tuple(_cell(row[names.index(c)]) for c in order) for row in duck.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).limit(5).count() > 0


def test_entry_without_llm():
    """The entry module must import where the llm subpackage is gone."""
    import subprocess
    import sys
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        subprocess.run(["cp", "-r", f"{root}/dossierlake", f"{root}/__spark_entry__.py", d], check=True)
        subprocess.run(["rm", "-rf", f"{d}/dossierlake/llm"], check=True)
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sorted(e.queries()) and not [q for q in e.queries() if q.startswith('op')])"], cwd=d, capture_output=True, text=True)
        assert out.stdout.strip() == "True", out.stderr
