"""The operators' queries against their SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from dossierlake.llm import queries as Q

SF = "/root/testdata/sf0.001"


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    con.execute(Q.oracle_sql()[name])
    names = sorted(c[0] for c in con.description)
    theirs = sorted(tuple(cell(dict(zip([c[0] for c in con.description], row, strict=True))[n]) for n in names) for row in con.fetchall())
    got = Q.queries()[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(tuple(cell(r[n]) for n in names) for r in got.collect()) == theirs
