"""Every registered query against its independent DuckDB SQL: on the
driver's sf0.001 tables (through the fixture prelude, as the driver does at
sf0.01) and on the hand-made edge fixture (same SQL bodies, no prelude)."""

import pytest

from subscope.oracle.compare import duck_result, same, spark_result
from subscope.oracle.sql import oracle_bodies, oracle_sql, standalone
from subscope.params import DEFAULT_PARAMS
from subscope.plans.registry import builders, queries
from tests.conftest import SF_SMALL

KEYS = sorted(builders())


def test_every_query_has_oracle_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle_on_test_data(key, spark, duck_small):
    ok, why = same(spark_result(queries()[key](spark, SF_SMALL)), duck_result(duck_small, oracle_sql()[key]))
    assert ok, why


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle_on_edge_fixture(key, edge, duck_edge):
    got = spark_result(builders()[key](edge, DEFAULT_PARAMS))
    ok, why = same(got, duck_result(duck_edge, standalone(oracle_bodies()[key])))
    assert ok, why
