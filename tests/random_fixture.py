"""Seeded random canonical tables for differential testing (Spark vs the
oracle SQL). Domains are small on purpose so that the traps collide:
several raw spellings of one padded key, tied first-day orders with mixed
reasons, NULL statuses / reasons / dates / ages / bills, blank-padded and
accented location names, repeated catalogue rows, churn dates in the
previous year. Most accounts are shaped like churners (last snapshot in the
churn month, disconnect orders 0-4 months earlier, a sale before the churn),
so the churn reports are not vacuous; a share of them fails each test."""

from __future__ import annotations

import datetime as dt
import random

D = dt.date
TS = dt.datetime


def _month_end(y: int, m: int) -> dt.date:
    return D(y + (m == 12), m % 12 + 1, 1) - dt.timedelta(days=1)


def _shift_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.month - 1 + n, 12)
    y, m = d.year + y, m + 1
    return D(y, m, min(d.day, _month_end(y, m).day))


def random_tables(seed: int) -> dict[str, list[dict]]:
    r = random.Random(seed)
    raw = [str(i) for i in range(1, 19)] + ["0000000003", "0000000007", "990000000005", "12345678901"]
    districts = [f"San José {i}" for i in range(4)] + ["Ávila"]
    cantons = [f"Cantón {i}" for i in range(3)]
    provinces = ["Región 1", "Región 2"]

    def fold_up(name: str) -> str:
        for a, b in zip("áéíóú", "aeiou"):
            name = name.replace(a, b)
        return name.upper()

    def code(name: str) -> str:
        up = fold_up(name)
        return r.choice([up, up, f" {up} ", up + " ", up.replace("Á", "A")])

    crm, orders, activations = [], [], []
    for acct in raw:
        churner = r.random() < 0.75
        c = None
        if churner:
            cm = r.choice([3, 5, 5, 8, 8, 10, 10, 11])
            # a month-end churn coincides with the last snapshot (district churn rate)
            c = _month_end(2021, cm) if r.random() < 0.4 else D(2021, cm, r.choice([1, 10, 15, 28]))
        last_month = c.month if churner else r.randint(6, 12)
        if churner and r.random() < 0.15:
            last_month = min(12, last_month + 1)  # fails the month test
        first = c
        if churner and r.random() < 0.25:
            first = _shift_months(c, -r.randint(1, 3))  # an earlier first churn date
            if r.random() < 0.2:
                first = D(2020, first.month, first.day)  # first churn outside the year
        install = TS(r.choice([2019, 2021, 2021]), r.randint(1, 4), r.choice([1, 5, 10]), r.choice([0, 9]))
        loc = (r.choice(districts), r.choice(cantons), r.choice(provinces))
        for m in range(r.randint(1, 3), last_month + 1):
            for snap in (D(2021, m, 10), _month_end(2021, m)):
                if r.random() < 0.15 and m != last_month:
                    continue
                cts = None
                if churner and first is not None and snap >= first:
                    cts = first if snap < c else c
                if r.random() < 0.1:
                    loc = (r.choice(districts), r.choice(cantons), r.choice(provinces))
                crm.append(dict(
                    account_id=acct, snapshot_date=snap,
                    churn_ts=None if cts is None else TS(cts.year, cts.month, cts.day, r.choice([0, 0, 13])),
                    install_ts=install if r.random() < 0.9 else install + dt.timedelta(hours=5),
                    age_months=None if r.random() < 0.1 else float(r.choice([0, 1, 1.5, 2, 3, 6, 7, 12, 12.5, 24, 25, 40])),
                    bb_product_id=r.choice([None, "BB1", "BB1", "BB2"]), bb_product_name=r.choice([None, "Internet 1"]),
                    tv_product_id=r.choice([None, "TV1"]), vo_product_id=r.choice([None, "VO1"]),
                    bb_mrc=None if r.random() < 0.1 else r.choice([0.0, 10.25, 12.5, 20.0]),
                    bb_mrc_discount=r.choice([0.0, 0.5]), tv_mrc=r.choice([0.0, 5.0, 7.25]),
                    tv_mrc_discount=r.choice([0.0, 0.25]), vo_mrc=r.choice([0.0, 3.0]), vo_mrc_discount=0.0,
                    vo_billed_raw=r.choice([None, "N/A", "2", "3.5"]),
                    bb_billed=None if r.random() < 0.1 else r.choice([9.5, 10.0, 12.25]),
                    tv_billed=r.choice([0.0, 5.0]),
                    district_code=code(loc[0]), canton_code=code(loc[1]), province_code=code(loc[2]),
                ))
        # disconnect orders around the first churn, with ties and noise
        if churner:
            anchor = first if first is not None else c
            for _ in range(r.randint(1, 3)):
                day = _shift_months(anchor, -r.choice([0, 0, 1, 2, 3, 4])) if r.random() < 0.9 else anchor + dt.timedelta(days=3)
                orders.append(dict(
                    contract_id=acct if r.random() < 0.8 else acct.zfill(10), opened_on=day,
                    order_type="DESINSTALACION" if r.random() < 0.9 else "INSTALACION",
                    status=r.choice([None, "CANCELADA", "ANULADA", "FINALIZADA", "FINALIZADA", "FINALIZADA"]),
                    sub_reason=r.choice([None, "MOROSIDAD", "MOROSIDAD", "PRECIO", "COMPETENCIA"]),
                ))
                if r.random() < 0.3:  # tied order, other reason
                    o = dict(orders[-1])
                    o["sub_reason"] = r.choice([None, "MOROSIDAD", "PRECIO"])
                    orders.append(o)
        if r.random() < 0.2:
            orders.append(dict(contract_id=acct, opened_on=None, order_type="DESINSTALACION", status="FINALIZADA",
                               sub_reason="PRECIO"))
        # a sale on the install day (most before the churn)
        if r.random() < 0.8:
            sold = install.date() if r.random() < 0.85 else install.date() + dt.timedelta(days=1)
            for _ in range(r.choice([1, 1, 2])):
                activations.append(dict(
                    contract_id=acct if r.random() < 0.8 else acct.zfill(10), sold_on=sold,
                    channel=r.choice(["TIENDA", "WEB", "CALL"]), sale_type=r.choice(["Nueva", "Nueva", "Nueva", "Migracion"]),
                    customer_type=r.choice(["RESIDENCIAL", "EMPLEADO", "PROGRAMA HOGARES CONECTADOS", "PYMES"]),
                    movement_type=r.choice(["Altas por venta", "Altas por venta", "Altas por venta", "Bajas"]),
                    reason=r.choice(["VENTA", "VENTA NUEVA ", "VENTA NUEVA ", "VENTA NUEVA"]),
                    subchannel=r.choice(["TIENDA", "INBOUND PYMES"]),
                ))

    speeds = [dict(contract_id=a if r.random() < 0.7 else a.zfill(10), speed_range=r.choice(["50 Mbps", "100 Mbps"]))
              for a in r.sample(raw, 12)]

    catalogue = []
    for d in districts:
        for cn in r.sample(cantons, r.choice([1, 2])):  # names in two cantons
            for _ in range(r.choice([1, 1, 1, 2])):  # repeated rows
                catalogue.append(dict(province=r.choice(provinces), canton=cn, district=d,
                                      economic_band=r.choice([None, "E1", "E2", "E2"]), ids_2017=r.choice([1.0, 2.5])))

    return dict(crm_snapshots=crm, service_orders=orders, activations=activations, speed_inventory=speeds,
                district_index=catalogue)
