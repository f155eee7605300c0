"""Every query with SQL against DuckDB on the same tables, as the driver compares them."""

import os

import duckdb
import pandas as pd
import pytest

from relaywright.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SCALES = os.environ["ORACLE_SF"].split(",") if "ORACLE_SF" in os.environ else ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


@pytest.fixture(scope="module", params=SCALES)
def tables(request):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{request.param}/{t}.parquet'")
    return request.param, c


def plain(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(plain(y) for y in x)
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return round(x, 9)
    if hasattr(x, "item"):
        return plain(x.item())
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, tables, name):
    sf_dir, duck = tables
    df = QUERIES[name](spark, sf_dir)
    found = df.collect()
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in found), key=repr)
    theirs = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want), key=repr)
    assert ours == theirs
