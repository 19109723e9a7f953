"""Every operator query with DuckDB SQL equals it, on the driver's tables."""

import duckdb
import pytest

from subscope.llm.queries import ORACLE_SQL, QUERIES
from subscope.oracle.compare import duck_result, same, spark_result


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, key, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    ok, why = same(spark_result(QUERIES[key](spark, f"/root/testdata/{sf}")), duck_result(con, ORACLE_SQL[key]))
    assert ok, why


def test_one_query_per_operator():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14))
