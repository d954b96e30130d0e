"""Every query against its SQL in DuckDB, at the smallest size."""

import os

import duckdb
import pandas as pd
import pytest

from corpuscle.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def same(a: pd.DataFrame, b: pd.DataFrame) -> bool:
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    text = lambda x: x[columns].astype(object).where(x[columns].notna(), None).map(str).sort_values(columns).reset_index(drop=True)
    return text(a).equals(text(b))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    assert same(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
