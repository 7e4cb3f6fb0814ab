"""Every registered query with a SQL twin gives its twin's rows."""

import math
import os

import pytest

from nearlight.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings events"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_twin(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
