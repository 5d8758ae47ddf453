"""Every query with an oracle returns what DuckDB returns for its SQL."""

import math
import os

import duckdb
import pytest

from tests.conftest import SMALL
from tidewell.plans import ALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [(m, k) for m in ALL for k in m.ORACLES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


def rows(cols, data):
    return sorted((tuple(plain(r[c]) for c in cols) for r in data), key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("module,name", NAMES, ids=[k for _, k in NAMES])
def test_oracle(spark, duck, module, name):
    df = module.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = rows(cols, [r.asDict() for r in df.collect()])
    said = duck.execute(module.ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == cols
    assert got == rows(cols, [dict(zip(names, r)) for r in said.fetchall()])


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {k for m in ALL for k in m.QUERIES} <= set(entry.queries())
