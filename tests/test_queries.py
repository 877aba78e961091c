"""Every registered query with SQL against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tidemark.plans import ORACLES, QUERIES

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(round(float(v), 6) + 0.0 if isinstance(v, float) else v for v in (r[i] for i in order)))
    return sorted(out, key=repr), [names[i] for i in order]


def same(a, b):
    """Equal once rounded; sums of doubles in another order may differ by 2 parts in 10**9, which forgives no value near 1 that rounds to another millionth."""
    return a == b or (isinstance(a, float) and isinstance(b, (int, float)) and abs(a - b) <= 2e-9 * abs(b))


def test_half_a_millionth_is_told_apart():
    assert not same(0.215807, 0.215808) and same(1.2003418577009595e34, 1.2003418577009766e34) and same(2048.966563, 2048.966562)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got, columns = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want, names = canonical([c[0] for c in cur.description], cur.fetchall())
    assert columns == names
    assert len(got) == len(want) and len(got) > 0
    bad = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert not bad, bad[:3]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
