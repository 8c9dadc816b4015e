"""Every query of the driver contract against its SQL at the smallest scale."""

import math
from pathlib import Path

import pytest

from brassvane.plans import data_quality, details, market

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")
SETS = {**data_quality.QUERIES, **market.QUERIES, **details.QUERIES}
SQL = {**data_quality.SQL, **market.SQL, **details.SQL}


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6)
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in SF.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SETS))
def test_query(spark, con, name):
    df = SETS[name](spark, str(SF))
    cols = sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    if name not in SQL:
        return
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr([norm(dict(zip(names, r))[c]) for c in cols]) for r in res.fetchall())
