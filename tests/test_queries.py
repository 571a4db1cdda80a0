"""Every matrix query against its SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from lattica import queries


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, expected))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, duck, name):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


def test_fixture_values(spark, sf_dir):
    """The determinants that were computed once by dense factorisation."""
    assert queries.QUERIES["logdet_chain"](spark, sf_dir).agg({"logdet": "sum"}).first()[0] == pytest.approx(950.352866, abs=1e-4)
    assert queries.QUERIES["logdet_graph"](spark, sf_dir).first()["logdet"] == pytest.approx(743.984957, abs=1e-5)
    assert queries.QUERIES["logdet_dense"](spark, sf_dir).first()["logdet"] == pytest.approx(135.936133, abs=1e-5)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bipartite_fill_covers_pattern(spark, sf_dir):
    from lattica.operators import numeric

    a = queries.d2(spark, sf_dir)
    fill = numeric.factor_pattern(a)
    assert a.join(fill, ["matrix_id", "i", "j"], "left_anti").isEmpty() and fill.count() >= a.count()
