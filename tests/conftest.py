import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
BASE_VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="session")
def spark():
    from subscope.session import build_session

    s = build_session(master="local[4]", shuffle_partitions=8, app="subscope-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    import duckdb

    con = duckdb.connect()
    for n in BASE_VIEWS:
        path = f"{SF_SMALL}/{n}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


@pytest.fixture(scope="session")
def edge(spark):
    from tests.edge_fixture import edge_tables

    return edge_tables(spark)


@pytest.fixture(scope="session")
def duck_edge():
    import duckdb

    from tests.edge_fixture import register_duckdb

    con = duckdb.connect()
    register_duckdb(con)
    yield con
    con.close()
