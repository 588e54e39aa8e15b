import os

import duckdb
import pytest

from quern.plans import catalogue

BASE = "/root/testdata/sf0.001"
con = duckdb.connect()
for file in os.listdir(BASE):
    con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{BASE}/{file}'")


@pytest.mark.parametrize("name", catalogue.queries())
def test_equals_sql(spark, name):
    found = catalogue.queries()[name](spark, BASE)
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)
