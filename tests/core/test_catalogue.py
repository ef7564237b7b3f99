"""Every query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from foldlog.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return c


def shown(frame, columns):
    plain = lambda x: "" if pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(plain, row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    wanted = con.execute(catalogue.ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    assert shown(got, columns) == shown(wanted, columns)


def test_names_match():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
