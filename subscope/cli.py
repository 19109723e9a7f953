"""Run reports from the command line (``spark-submit -m`` style).

    python -m subscope.cli --tables /warehouse/subscope --out /results \\
        --report bundle_churners_by_month --report district_churn_rate --year 2021

Reads the five canonical tables with their declared schemas
(:func:`subscope.sources.tables.read_tables`), runs each report with the
parameters given as flags and writes every result as parquet under
``--out/<report>``. On a cluster the session comes from ``spark-submit``;
only the library settings are applied to it.
"""

from __future__ import annotations

import argparse
import dataclasses
import datetime as dt

from pyspark.sql import SparkSession

from subscope.functions.sql import register_sql_functions
from subscope.operators.history import HISTORY_REPORTS, as_crm, read_history
from subscope.operators.traps import log_warnings, watched
from subscope.params import ReportParams
from subscope.plans.reports import REPORTS
from subscope.plans.sql_reports import register_report_functions
from subscope.session import configure
from subscope.sources.buckets import read_bucketed
from subscope.sources.tables import read_tables


def _months(text: str) -> tuple[dt.date, ...]:
    """``2021-05,2021-06`` -> first days of those months."""
    out = []
    for item in text.split(","):
        y, m = item.strip().split("-")[:2]
        out.append(dt.date(int(y), int(m), 1))
    return tuple(out)


def _month_or_all(text: str) -> int | str:
    """A month number, or ``all`` for no filter."""
    return "all" if text == "all" else int(text)


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    ap = argparse.ArgumentParser(prog="subscope", description=__doc__.split("\n\n")[0])
    ap.add_argument("--tables", required=True, help="root folder of the five tables (read_tables layout)")
    ap.add_argument("--out", required=True, help="output folder; one parquet dataset per report")
    ap.add_argument("--report", action="append", choices=sorted(REPORTS), help="report to run (repeatable; default all)")
    ap.add_argument("--sql", action="append", help="a SELECT over the tables and the reports as SQL functions, e.g. "
                    "\"SELECT * FROM district_churn_rate(2021, 3)\"; written to --out/sql_<n> (repeatable)")
    ap.add_argument("--format", default="parquet", help="input format of the tables")
    ap.add_argument("--mode", default="errorifexists", help="save mode of the outputs")
    ap.add_argument("--year", type=int)
    ap.add_argument("--max-order-lead-months", type=int)
    ap.add_argument("--strict-status", action="store_true")
    ap.add_argument("--churn-month-district", type=_month_or_all, help="1-12 or all")
    ap.add_argument("--churn-month-tenure", type=_month_or_all, help="1-12 or all")
    ap.add_argument("--churn-month-ids", type=_month_or_all, help="1-12 or all")
    ap.add_argument("--active-month", type=_month_or_all, help="1-12 or all")
    ap.add_argument("--by-active-month", action="store_true")
    ap.add_argument("--sale-month", type=_month_or_all, help="1-12 or all")
    ap.add_argument("--by-sale-month", action="store_true")
    ap.add_argument("--by-subchannel", action="store_true")
    ap.add_argument("--excluded-subchannels", help="comma-separated")
    ap.add_argument("--analysis-months", type=_months, help="e.g. 2021-05,2021-06,2021-07")
    ap.add_argument("--active-months", type=_months, help="e.g. 2021-07,2021-08")
    ap.add_argument("--churn-horizon-months", type=int)
    ap.add_argument("--by-month", action="store_true")
    ap.add_argument("--inspect", action="store_true", help="churn rate: per-district contract counts instead")
    ap.add_argument("--conform-types", action="store_true",
                    help="read the tables as stored and cast to the declared schema")
    ap.add_argument("--bucketed", action="store_true", help="the tables were written by write_bucketed")
    ap.add_argument("--history", help="folder of the stored CRM history; reports that can run from it do")
    ap.add_argument("--watch", action="store_true",
                    help="count odd input rows while a report runs, into --out/<report>_counts and the log")
    return ap.parse_args(argv)


def params_from(args: argparse.Namespace) -> ReportParams:
    given = {}
    for f in dataclasses.fields(ReportParams):
        v = getattr(args, f.name, None)
        if v is None or v is False:
            continue
        if f.name == "excluded_subchannels":
            v = tuple(s.strip() for s in v.split(",") if s.strip())
        given[f.name] = None if v == "all" else v
    return dataclasses.replace(ReportParams(), **given)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    args = parse_args(argv)
    spark = configure(spark or SparkSession.builder.appName("subscope").getOrCreate())
    if args.bucketed:
        tables = read_bucketed(spark, args.tables)
    else:
        tables = read_tables(spark, args.tables, fmt=args.format, conform_types=args.conform_types)
    short = tables
    if args.history:
        short = dataclasses.replace(tables, crm=as_crm(read_history(spark, args.history)))
    p = params_from(args)
    written = []
    if args.sql:
        tables.views(spark)
        register_sql_functions(spark)
        register_report_functions(spark, tables, p)
    for n, text in enumerate(args.sql or [], 1):
        path = f"{args.out}/sql_{n}"
        spark.sql(text).write.mode(args.mode).parquet(path)
        written.append(path)
    for name in args.report or ([] if args.sql else sorted(REPORTS)):
        path = f"{args.out}/{name}"
        source = short if name in HISTORY_REPORTS else tables
        if args.watch and source is tables:  # a history has no single snapshots to count
            source, watch = watched(source)
            report = REPORTS[name](source, p)
            report.write.mode(args.mode).parquet(path)
            counts = watch.counts(report)
            rows = [(table, counter, n) for table, own in counts.items() for counter, n in own.items()]
            if rows:
                spark.createDataFrame(rows, "table string, counter string, n long").coalesce(1).write.mode(
                    args.mode).parquet(f"{path}_counts")
            log_warnings(name, counts)
        else:
            REPORTS[name](source, p).write.mode(args.mode).parquet(path)
        written.append(path)
    return written


if __name__ == "__main__":
    main()
