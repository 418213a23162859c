"""Every registered query against its DuckDB oracle on sf0.001 (order-blind, float tolerance 1e-6)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from oracle_check import compare
from paths import SF_SMALL

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    msg = compare(got, want)
    assert msg is None, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_query_runs(spark, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    assert len(got) > 0 and got.columns.is_unique
    assert not got.isna().all(axis=None)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
