"""The bundle of canonical input tables every report takes."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subscope.functions.exprs import folded_upper
from subscope.sources import schema as S


class _OnUse:
    """A field given as a DataFrame, or as a function that is called when the
    table is first asked for."""

    def __set_name__(self, owner, name: str) -> None:
        self.slot = name

    def __get__(self, tables, owner=None) -> DataFrame:
        if tables is None:
            raise AttributeError(self.slot)  # no default
        given = tables.__dict__[self.slot]
        if callable(given):
            given = tables.__dict__[self.slot] = given()
        return given

    def __set__(self, tables, given) -> None:
        tables.__dict__[self.slot] = given


Given = DataFrame | Callable[[], DataFrame]


@dataclass(frozen=True, repr=False, eq=False)
class Tables:
    crm: Given = _OnUse()  # crm_snapshots: account x snapshot date
    orders: Given = _OnUse()  # service_orders: one row per order
    activations: Given = _OnUse()  # sale movements
    speeds: Given = _OnUse()  # speed_inventory: contract -> speed range
    districts: Given = _OnUse()  # district_index: socio-economic catalogue

    def views(self, spark: SparkSession) -> None:
        """Register the tables as temp views under their canonical names."""
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(name)

    def as_dict(self) -> dict[str, DataFrame]:
        return {
            "crm_snapshots": self.crm,
            "service_orders": self.orders,
            "activations": self.activations,
            "speed_inventory": self.speeds,
            "district_index": self.districts,
        }


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet", conform_types: bool = False,
                check_catalogue: bool = True) -> Tables:
    """Read the five tables from ``root/<name>`` with their declared schemas.

    By default the declared schema is imposed on the read: no inference, and
    a stored type that differs fails at read time. ``conform_types=True`` is
    for exports whose types differ but convert (e.g. a numeric account id):
    the files are read as stored and each column is cast to its declared
    type (a missing column still fails).

    The CRM table is best stored partitioned by snapshot date (see
    :func:`write_tables`) so that the date ranges the reports filter on prune
    whole directories. ``check_catalogue`` logs repeated catalogue keys,
    which inflate the district reports (T22).
    """

    def rd(name: str) -> DataFrame:
        if conform_types:
            return S.conform(spark.read.format(fmt).load(f"{root}/{name}"), S.SCHEMAS[name])
        df = spark.read.format(fmt).schema(S.SCHEMAS[name]).load(f"{root}/{name}")
        return df.select(*S.SCHEMAS[name].fieldNames())

    out = Tables(
        crm=rd("crm_snapshots"),
        orders=rd("service_orders"),
        activations=rd("activations"),
        speeds=rd("speed_inventory"),
        districts=rd("district_index"),
    )
    if check_catalogue:
        warn_on_duplicate_catalogue(out.districts)
    return out


def tables_from_catalog(spark: SparkSession, names: dict[str, str],
                        columns: dict[str, dict[str, str]] | None = None) -> Tables:
    """The five tables from a catalog: ``names`` gives each canonical table's
    catalog name, ``columns`` (optional, by canonical table) the catalog's
    name of a canonical column where it differs. Every column is cast to its
    declared type; a missing one fails."""
    missing = set(S.SCHEMAS) - set(names)
    if missing:
        raise ValueError(f"no catalog name for {sorted(missing)}")

    def rd(name: str) -> DataFrame:
        df, given = spark.table(names[name]), (columns or {}).get(name, {})
        fields = S.SCHEMAS[name].fieldNames()
        return S.conform(df.select(*[F.col(given.get(f, f)).alias(f) for f in fields]), S.SCHEMAS[name])

    return from_frames(*[rd(n) for n in (
        "crm_snapshots", "service_orders", "activations", "speed_inventory", "district_index")])


def write_tables(t: Tables, root: str, mode: str = "errorifexists", fmt: str = "parquet",
                 max_records_per_file: int = 5_000_000) -> None:
    """Write the five tables under ``root/<name>`` in the layout the reports
    prune best: the CRM table partitioned by ``snapshot_date`` (every report
    filters or joins on it: static date windows prune directories, and the
    revenue report's join to its few month-end dates prunes dynamically),
    the others as plain files. Use a shared (cluster) path for ``root``.

    The rows are rebalanced by ``snapshot_date`` first: adaptive execution
    merges small dates into one task and splits a large date over several, so
    a date has as many files as its size needs, however many tasks feed the
    write, and no date's volume is funnelled through one task.
    """
    t.crm.hint("rebalance", "snapshot_date").write.mode(mode).format(fmt).option(
        "maxRecordsPerFile", max_records_per_file).partitionBy("snapshot_date").save(f"{root}/crm_snapshots")
    for name, df in t.as_dict().items():
        if name != "crm_snapshots":
            df.write.mode(mode).format(fmt).save(f"{root}/{name}")


def from_frames(crm: DataFrame, orders: DataFrame, activations: DataFrame, speeds: DataFrame,
                districts: DataFrame) -> Tables:
    """Conform arbitrary DataFrames to the declared schemas."""
    return Tables(
        crm=S.conform(crm, S.CRM_SNAPSHOTS),
        orders=S.conform(orders, S.SERVICE_ORDERS),
        activations=S.conform(activations, S.ACTIVATIONS),
        speeds=S.conform(speeds, S.SPEED_INVENTORY),
        districts=S.conform(districts, S.DISTRICT_INDEX),
    )


def duplicate_catalogue_keys(districts: DataFrame) -> DataFrame:
    """Catalogue match keys (upper-cased folded province, canton, district)
    that occur more than once. The district churner reports count a churner
    once per matching catalogue row (T22), so duplicates inflate them."""
    keys = [folded_upper(c).alias(c) for c in ("province", "canton", "district")]
    return districts.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def warn_on_duplicate_catalogue(districts: DataFrame, log: logging.Logger | None = None, shown: int = 20) -> int:
    """Log a warning with the number of repeated catalogue keys and a sample
    of ``shown`` of them; returns the number, counted over all."""
    log = log or logging.getLogger("subscope")
    dups = duplicate_catalogue_keys(districts)
    n = dups.count()
    if n:
        some = ", ".join(f"{r.province} / {r.canton} / {r.district} ({r.copies})" for r in dups.limit(shown).collect())
        log.warning("%d district catalogue keys are repeated, among them: %s", n, some)
    return n
