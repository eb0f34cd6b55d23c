import os

import duckdb
import pytest

import __spark_entry__
from strandloom.plans import registry

D = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(str, frame[sorted(frame.columns)].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_equals_sql(spark, name):
    got = registry.queries()[name](spark, D).toPandas()
    sql = registry.oracle_sql()[name]
    con = duckdb.connect()
    for file in os.listdir(D):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{D}/{file}')")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
