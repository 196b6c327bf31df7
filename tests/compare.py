"""Order-free comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, dt.date):
        return value.isoformat() + " 00:00:00"
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(shaped, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def assert_same(df, duck, sql):
    relation = duck.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    got = rows_of(df.columns, df.collect())
    want = rows_of(relation.columns, relation.fetchall())
    assert len(got) == len(want), f"{len(got)} rows, expected {len(want)}"
    different = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not different, f"{len(different)} rows differ, first: {different[0]}"
    return len(got)
