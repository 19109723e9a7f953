"""The CRM and order tables bucketed by padded contract.

The churn reports first keep the CRM rows whose contract has a disconnect
order. On plain files that moves the CRM to its contracts in every run.
Bucketed by contract it is moved once, when it is written: the join and all
the steps by contract after it read the buckets in place.

:func:`write_bucketed` adds the column ``contract`` to both tables and writes
them with the same number of buckets, sorted by contract; the CRM stays
partitioned by snapshot date, so date filters still prune folders. Files with
buckets are known as such only by a catalog, so :func:`read_bucketed` declares
them as external tables of the session's catalog (a table of that name is
declared anew; its files stay).

Choose ``buckets`` for the CRM columns of one report: a bucket of all dates is
one task's, some 200 MB of it. A task writes one file for each of its dates.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from subscope.functions import exprs as X
from subscope.sources import schema as S
from subscope.sources.tables import Tables, read_tables

# table, the column that identifies the contract, the partition column
_BUCKETED = (("crm_snapshots", "account_id", "snapshot_date"), ("service_orders", "contract_id", None))
_LAYOUT = "bucket_layout"


def write_bucketed(t: Tables, spark: SparkSession, root: str, buckets: int, mode: str = "errorifexists") -> None:
    """Write the five tables under ``root``, a shared path: the CRM and the
    orders bucketed, the others as plain files. ``mode`` is that of a
    DataFrame writer, for the whole folder of a table."""
    if buckets < 1:
        raise ValueError("buckets is at least 1")
    frames = t.as_dict()
    for name, key, by in _BUCKETED:
        # hash partitioning by contract is what a bucket number is made of, so a task holds one bucket
        rows = frames.pop(name).withColumn("contract", X.pad_key(key)).repartition(buckets, "contract")
        out = rows.write.mode(mode).bucketBy(buckets, "contract").sortBy("contract").format("parquet")
        if by:
            out = out.partitionBy(by)
        made = f"{name}_being_written"
        spark.sql(f"DROP TABLE IF EXISTS {made}")
        try:
            out.option("path", f"{root}/{name}").saveAsTable(made)
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {made}")  # external: the files stay
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{root}/{name}")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode(mode).json(f"{root}/{_LAYOUT}")


def read_bucketed(spark: SparkSession, root: str, prefix: str = "subscope_", check_catalogue: bool = True) -> Tables:
    """The tables that :func:`write_bucketed` wrote. The CRM and the orders
    are declared as ``<prefix>crm_snapshots`` and ``<prefix>service_orders``
    in the current database."""
    buckets = spark.read.schema("buckets int").json(f"{root}/{_LAYOUT}").first().buckets
    plain = read_tables(spark, root, check_catalogue=check_catalogue)
    crm, orders = (_declared(spark, root, prefix, buckets, *spec) for spec in _BUCKETED)
    return dataclasses.replace(plain, crm=crm, orders=orders)


def _declared(spark: SparkSession, root: str, prefix: str, buckets: int, name: str, key: str, by: str | None) -> DataFrame:
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in S.SCHEMAS[name].fields]
    table = f"{prefix}{name}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(f"""CREATE TABLE {table} ({', '.join(fields)}, contract string) USING parquet
                  {f'PARTITIONED BY ({by})' if by else ''}
                  CLUSTERED BY (contract) SORTED BY (contract) INTO {buckets} BUCKETS
                  LOCATION '{root}/{name}'""")
    if by:
        spark.catalog.recoverPartitions(table)
    return spark.table(table).select(*S.SCHEMAS[name].fieldNames(), "contract")
