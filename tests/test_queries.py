"""Every query with an oracle against DuckDB, by value, on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tablewright import stateful  # noqa: F401  registers its queries
from tablewright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    return c


def values(names, rows):
    cols = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in cols) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert values(df.columns, [tuple(r) for r in df.collect()]) == values(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
