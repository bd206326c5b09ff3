"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import duckdb
import pytest

from quillstack.plans import index_queries, more_queries  # noqa: F401  they register their queries
from quillstack.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    return None if v is None else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    want = [dict(zip(cols, r)) for r in cur.fetchall()]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((x is None, x or "") for x in r)
    got = sorted((tuple(cell(r[c]) for c in sorted(cols)) for r in rows), key=key)
    assert got == sorted((tuple(cell(r[c]) for c in sorted(cols)) for r in want), key=key)
