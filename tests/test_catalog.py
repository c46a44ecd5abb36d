"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_point
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (int, str, bool)) else str(v)


def table(rows):
    return sorted(
        (tuple(value(v) for v in r) for r in rows),
        key=lambda t: tuple((v is None, str(type(v)), v) for v in t),
    )


NAMES = [name for name, query in entry_point.queries().items() if query.__module__.startswith("catalog.")]


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = duck.sql(entry_point.oracle_sql()[name])
    assert sorted(result.columns) == columns
    order = [result.columns.index(c) for c in columns]
    expected = table([row[i] for i in order] for row in result.fetchall())
    assert table(df.select(*columns).collect()) == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
