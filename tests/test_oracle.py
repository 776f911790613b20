"""Every registered query of the graph engine against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from xrefloom.plans.queries import SQL, Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(df: pd.DataFrame) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r)) for r in df[names].itertuples(index=False))


def test_all_have_sql():
    assert set(Q) == set(SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q))
def test_equals_sql(spark, duck, name):
    df = Q[name](spark, SF)
    got = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    want = duck.execute(SQL[name]).to_arrow_table()
    want = pd.DataFrame(want.to_pylist(), columns=want.column_names, dtype=object)
    assert rows(got) == rows(want)
