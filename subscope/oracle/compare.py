"""Order-insensitive comparison of two result sets (column names sorted,
floats compared at 9 decimals, NULLs sorted first)."""

from __future__ import annotations

import datetime as dt
import math


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, f"{round(v, 9):.9f}")
    if isinstance(v, (dt.datetime, dt.date)):
        return (1, v.isoformat())
    if hasattr(v, "__float__") and not isinstance(v, int):
        return (1, f"{round(float(v), 9):.9f}")
    return (1, str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def spark_result(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_result(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same(a, b) -> tuple[bool, str]:
    ca, ra = canon(*a)
    cb, rb = canon(*b)
    if ca != cb:
        return False, f"columns differ: {ca} vs {cb}"
    if ra != rb:
        sa, sb = set(ra), set(rb)
        return False, (f"rows {len(ra)} vs {len(rb)}; only left {sorted(sa - sb)[:3]}; "
                       f"only right {sorted(sb - sa)[:3]}")
    return True, ""
