"""The registered queries that have SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_queries import canonical, same
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, size):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/{size}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = QUERIES[name](spark, f"{DATA}/{size}")
    got, columns = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    want, names = canonical([c[0] for c in cur.description], cur.fetchall())
    assert columns == names and len(got) == len(want) > 0
    bad = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert not bad, bad[:3]
