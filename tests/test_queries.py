"""Each registered query against its SQL on the smallest tables; a sample of the others for shape."""

import math

import duckdb
import pytest

from tidebars.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.5f}".replace("-0.00000", "0.00000") if isinstance(v, (int, float)) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


def close(a, b):
    try:
        return abs(float(a) - float(b)) <= 2e-5 * max(1, abs(float(a)))
    except ValueError:
        return a == b


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    want = duck.sql(SQL[name])
    assert df.columns == want.columns
    got, expected = plain(map(tuple, df.collect())), plain(want.fetchall())
    assert len(got) == len(expected)
    assert all(close(x, y) for r, s in zip(got, expected) for x, y in zip(r, s))


@pytest.mark.parametrize("name", ["linear_channel", "joint_gap_boot", "exact_perm", "group_perm", "glauber_sim", "surrogates"])
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
