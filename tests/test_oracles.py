"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pytest

from veinwork.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows, columns):
    out = rows[columns].map(lambda v: round(float(v), 6) if isinstance(v, float) else str(v)).astype(str)
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert normal(got, columns).equals(normal(want, columns))
