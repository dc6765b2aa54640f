"""Every registered query against its SQL on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check import compare, connect
from reqsieve.plans.oracles import ORACLES
from reqsieve.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).columns == ["key", "n"] and contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_gives_rows(name):
    assert connect("/root/testdata/sf0.01").execute(ORACLES[name]).fetchone() is not None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None
