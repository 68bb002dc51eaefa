"""Every treebank query against its SQL in DuckDB, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from treeq.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents conversations"


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else int(x) if isinstance(x, bool) else x for x in row)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert Counter(plain(r) for r in df.select(*columns).collect()) == Counter(plain([r[i] for i in at]) for r in rel.fetchall())


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES])
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).limit(1).count() == 1
