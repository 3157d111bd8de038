"""Every query of the core library against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from fedspark.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).iterdir():
        con.execute(f"create view {path.name.split('.')[0]} as select * from '{path}'")
    return con


def rows(columns: list, values: list) -> list:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    text = lambda v: "null" if v is None else f"{v + 0.0:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[k]).replace("-0", "0") if text(r[k]) == "-0" else text(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found
    if sql := plans.ORACLE_SQL.get(name):
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert found == rows(columns, want.fetchall())
