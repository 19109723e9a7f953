"""Report parameters: every literal or commented-out switch of the analyses."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


def _months(year: int, *months: int) -> tuple[dt.date, ...]:
    return tuple(dt.date(year, m, 1) for m in months)


@dataclass(frozen=True)
class ReportParams:
    # analysis year of the churn / sales reports; None: every year (the
    # reports as SQL functions filter by year above, see plans/sql_reports.py)
    year: int | None = 2021
    # a disconnect order counts for a churn if opened at most this many
    # calendar months before the first churn date; None: no bound
    max_order_lead_months: int | None = 3
    # literal status predicate keeps every non-null status; True applies the
    # evident intent (neither cancelled nor annulled)
    strict_status: bool = False
    # number of contracts that the Bloom filter before the churn semi-join is
    # sized for; None: no filter (results are the same)
    order_filter_keys: int | None = None
    # least number of tasks that the CRM rows and the contracts of the orders
    # are dealt to by contract; None: left to Spark (results are the same)
    contract_tasks: int | None = None
    # month of the last churn date kept by the district churner reports
    churn_month_district: int | None = 8
    churn_month_tenure: int | None = 10
    churn_month_ids: int | None = 8
    # month of the active-contract report by district and index
    active_month: int | None = 8
    by_active_month: bool = False
    # sales cohort: optional sale month filter and split
    sale_month: int | None = None
    by_sale_month: bool = False
    by_subchannel: bool = False
    excluded_subchannels: tuple[str, ...] = ()
    # revenue trend: months compared (first of month) and months whose
    # active customers are reported; churn horizon after the last analysis month
    analysis_months: tuple[dt.date, ...] = field(default_factory=lambda: _months(2021, 5, 6, 7))
    active_months: tuple[dt.date, ...] = field(default_factory=lambda: _months(2021, 7, 8, 9, 10))
    churn_horizon_months: int = 3
    # churn rate by district: optional split by month of the last snapshot,
    # and an inspection mode returning the per-district contract counts
    by_month: bool = False
    inspect: bool = False

    def __post_init__(self) -> None:
        for name in ("analysis_months", "active_months"):
            months = tuple(sorted(set(getattr(self, name))))  # a repeated month counts once
            if not months:
                raise ValueError(f"{name} is empty")
            if any(d.day != 1 for d in months):
                raise ValueError(f"{name} takes first days of months")
            object.__setattr__(self, name, months)


DEFAULT_PARAMS = ReportParams()
