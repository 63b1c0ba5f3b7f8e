"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tramline.plans import catalog, feeds, maps, scalars, schedule  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return c


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = plain(df.select(*(f"`{c}`" for c in names)).collect())
    answer = duck.execute(catalog.SQL[name])
    at = [[c[0] for c in answer.description].index(n) for n in names]
    assert got == plain([r[i] for i in at] for r in answer.fetchall())
