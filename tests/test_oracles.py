"""Every query with an oracle gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from pagestream import queries as core

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 4) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 4)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([str(plain(r[i])) for i in order] for r in data))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    df = core.queries()[name](spark, DIR)
    cursor = duck.execute(core.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(c[0] for c in cursor.description)
    assert got == want
