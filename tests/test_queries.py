"""Every query with an SQL counterpart returns its rows, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


def value(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = duck.execute(SQL[name])
    columns = [d[0] for d in rows.description]
    assert sorted(columns) == names
    want = Counter(tuple(value(r[columns.index(c)]) for c in names) for r in rows.fetchall())
    assert Counter(tuple(map(value, r)) for r in df.select(*names).collect()) == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["pair_id", "lang", "side", "idx", "tok", "label"]
