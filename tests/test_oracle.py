"""Every query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from sparkact import queries as own
from sparkact import record_queries, report_queries, rule_queries, search_queries  # noqa: F401  add their queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", own.ORACLE)
def test_equals_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    result = duck.execute(own.ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(df.select(*names).collect()) == ordered(result.fetchall())


@pytest.mark.parametrize("name", sorted(own.QUERIES.keys() - own.ORACLE.keys()))
def test_others_run(spark, name):
    assert own.QUERIES[name](spark, DATA).columns
