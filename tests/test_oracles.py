"""Every query with SQL gives what DuckDB gives; the others run and give rows."""

import duckdb
import pytest

from quercus.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return repr(v)
    return repr(float(v)) if not hasattr(v, "isoformat") else v.isoformat()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in result.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
