"""Every query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from turnstone.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).tz_localize(None).isoformat()
        return round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else x

    rows = frame[sorted(frame.columns)].astype(object).to_numpy().tolist()
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_module():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
