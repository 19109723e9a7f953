"""Differential test: every registered query against its oracle SQL on
seeded random tables that make the traps collide (tests/random_fixture.py)."""

import os

import duckdb
import pytest

from subscope.oracle.compare import duck_result, same, spark_result
from subscope.oracle.sql import oracle_bodies, standalone
from subscope.params import DEFAULT_PARAMS
from subscope.plans.registry import builders
from tests.edge_fixture import register_rows, tables_from_rows
from tests.random_fixture import random_tables

SEEDS = [int(s) for s in os.environ.get("SUBSCOPE_RANDOM_SEEDS", "11,12").split(",")]
KEYS = sorted(builders())


@pytest.fixture(scope="module", params=SEEDS)
def world(request, spark):
    rows = random_tables(request.param)
    con = duckdb.connect()
    register_rows(con, rows)
    yield tables_from_rows(spark, rows), con
    con.close()


@pytest.mark.parametrize("key", KEYS)
def test_random_tables_match_oracle(world, key):
    t, con = world
    got = spark_result(builders()[key](t, DEFAULT_PARAMS))
    ok, why = same(got, duck_result(con, standalone(oracle_bodies()[key])))
    assert ok, why
