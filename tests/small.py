"""Small hand-written tables: a row states only the columns that matter."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import types as T

from stocklens.sources.schemas import AS_OF, TABLES

NOW = dt.datetime(2025, 12, 3)


def _value(value, kind):
    if value is None:
        return None
    if isinstance(kind, T.DecimalType):
        return Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
    if isinstance(kind, T.DateType) and isinstance(value, str):
        return dt.date.fromisoformat(value)
    if isinstance(kind, T.TimestampNTZType) and isinstance(value, str):
        return dt.datetime.fromisoformat(value)
    return value


def table(spark, name, rows):
    declared = TABLES[name]
    data = [
        tuple(
            _value(row.get(c.name, NOW if c.default == AS_OF else c.default), c.type)
            for c in declared.columns
        )
        for row in rows
    ]
    return spark.createDataFrame(data, declared.struct_type)


def tables(spark, **rows):
    """All ten tables; those not given are empty."""
    unknown = set(rows) - set(TABLES)
    assert not unknown, unknown
    return {name: table(spark, name, rows.get(name, [])) for name in TABLES}


def warehouse(number, **more):
    return {"warehouse_id": number, "warehouse_name": f"W{number}", "warehouse_type": "front", **more}


def place(site, name, capacity, utilization=0):
    return {"warehouse_id": site, "location": name, "capacity": capacity, "utilization": utilization}


def product(number, **more):
    base = {"product_id": number, "product_sku": f"S{number}", "product_name": f"P{number}", "volume": 1, "value": 1}
    return {**base, **more}


def person(number, site, **more):
    base = {
        "employee_id": number,
        "employee_number": f"E{number}",
        "employee_name": f"N{number}",
        "department": "warehouse_ops",
        "warehouse_id": site,
    }
    return {**base, **more}


def lot(number, product_id=1, site=1, where="A", total=10, locked=0, **more):
    base = {
        "inventory_id": number,
        "product_id": product_id,
        "warehouse_id": site,
        "storage_location": where,
        "total_quantity": total,
        "locked_quantity": locked,
        "available_quantity": total - locked,
    }
    return {**base, **more}


def inbound(number, product_id=1, kind="purchase", site=1, status="pending", quantity=0, operator=1, **more):
    base = {
        "inbound_id": number,
        "product_id": product_id,
        "inbound_type": kind,
        "warehouse_id": site,
        "status": status,
        "actual_quantity": quantity,
        "expected_quantity": quantity,
        "operator": operator,
    }
    return {**base, **more}


def outbound(number, product_id=1, kind="sales", site=1, status="pending", quantity=1, **more):
    base = {
        "outbound_id": number,
        "product_id": product_id,
        "outbound_type": kind,
        "warehouse_id": site,
        "status": status,
        "total_quantity": quantity,
    }
    return {**base, **more}


def dicts(df):
    return [r.asDict() for r in df.collect()]
