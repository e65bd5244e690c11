"""Result comparison used by the oracle tests (order-insensitive, exact values)."""

import math


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (1, repr(float(v)))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, repr(v))


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted(tuple(norm(r[i]) for i in idx) for r in data)
