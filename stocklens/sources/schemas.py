"""Declared schemas and the rule metadata attached to every column.

A table is a tuple of :class:`Column`.  ``struct_type`` turns it into the
``StructType`` readers use; the audits and the ingest job read the rule parts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import types as T

# These must equal the source system's for results to match.
WAREHOUSE_TYPES = ("central", "regional", "front")
WAREHOUSE_STATUSES = ("active", "inactive")
SUPPLIER_STATUSES = ("active", "inactive")
PRODUCT_STATUSES = ("active", "discontinued")
DEPARTMENTS = ("warehouse_ops", "order_processing", "quality_control", "system_admin")
EMPLOYMENT_STATUSES = ("active", "terminated", "leave")
INVENTORY_STATUSES = ("normal", "hold", "quarantine")
INBOUND_TYPES = ("purchase", "transfer", "return")
INBOUND_STATUSES = ("pending", "receiving", "completed", "cancelled")
OUTBOUND_TYPES = ("sales", "transfer", "return")
OUTBOUND_STATUSES = ("pending", "picking", "packing", "shipped", "cancelled")
ADJUSTMENT_TYPES = ("count", "transfer", "write_off", "split")

#: Default marker: the column takes the run's ``as_of`` timestamp when absent.
AS_OF = "as_of"

INT = T.IntegerType()
LONG = T.LongType()
TEXT = T.StringType()
BOOL = T.BooleanType()
DATE = T.DateType()
STAMP = T.TimestampNTZType()


def dec(precision: int, scale: int) -> T.DecimalType:
    return T.DecimalType(precision, scale)


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    required: bool = False
    default: object = None
    allowed: tuple[str, ...] | None = None
    max_chars: int | None = None


@dataclass(frozen=True)
class Reference:
    """Foreign key: ``columns`` of the table point at ``parent_columns`` of ``parent``."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str  # cascade | null | restrict


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...]
    columns: tuple[Column, ...]
    references: tuple[Reference, ...] = ()
    unique: tuple[str, ...] = ()
    #: (rule name, SQL condition that must not be FALSE)
    checks: tuple[tuple[str, str], ...] = field(default=())

    @property
    def struct_type(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


WAREHOUSES = Table(
    "warehouses",
    ("warehouse_id",),
    (
        Column("warehouse_id", INT, required=True),
        Column("warehouse_name", TEXT, required=True, max_chars=100),
        Column("warehouse_type", TEXT, required=True, allowed=WAREHOUSE_TYPES),
        Column("address", TEXT),
        Column("contact_person", TEXT, max_chars=50),
        Column("phone_number", TEXT, max_chars=50),
        Column("status", TEXT, default="active", allowed=WAREHOUSE_STATUSES),
        Column("created_time", STAMP, default=AS_OF),
    ),
)

LOCATIONS = Table(
    "locations",
    ("warehouse_id", "location"),
    (
        Column("warehouse_id", INT, required=True),
        Column("location", TEXT, required=True, max_chars=100),
        Column("capacity", dec(12, 4), required=True),
        Column("utilization", dec(12, 4)),
    ),
    references=(Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "cascade"),),
    checks=(
        ("capacity_positive", "capacity > 0"),
        ("utilization_within_capacity", "utilization <= capacity"),
    ),
)

SUPPLIERS = Table(
    "suppliers",
    ("supplier_id",),
    (
        Column("supplier_id", INT, required=True),
        Column("supplier_name", TEXT, required=True, max_chars=200),
        Column("contact_info", TEXT),
        Column("supply_cycle", INT),
        Column("status", TEXT, default="active", allowed=SUPPLIER_STATUSES),
    ),
)

PRODUCTS = Table(
    "products",
    ("product_id",),
    (
        Column("product_id", INT, required=True),
        Column("product_sku", TEXT, required=True, max_chars=50),
        Column("product_name", TEXT, required=True, max_chars=200),
        Column("product_description", TEXT),
        Column("category", TEXT, max_chars=50),
        Column("dimensions", TEXT, max_chars=100),
        Column("volume", dec(8, 2)),
        Column("weight", dec(8, 2)),
        Column("value", dec(10, 2)),
        Column("packaging_info", TEXT, max_chars=200),
        Column("status", TEXT, default="active", allowed=PRODUCT_STATUSES),
    ),
    unique=("product_sku",),
)

SUPPLIER_PRODUCTS = Table(
    "supplier_products",
    ("supplier_id", "product_id"),
    (
        Column("supplier_id", INT),
        Column("product_id", INT),
        Column("supplier_sku", TEXT, max_chars=50),
        Column("supply_price", dec(10, 2)),
        Column("min_order_quantity", dec(12, 4)),
        Column("lead_time_days", INT),
        Column("is_preferred", BOOL, default=False),
        Column("created_time", STAMP, default=AS_OF),
        Column("last_updated", STAMP, default=AS_OF),
    ),
    references=(
        Reference(("supplier_id",), "suppliers", ("supplier_id",), "cascade"),
        Reference(("product_id",), "products", ("product_id",), "cascade"),
    ),
)

EMPLOYEES = Table(
    "employees",
    ("employee_id",),
    (
        Column("employee_id", INT, required=True),
        Column("employee_number", TEXT, required=True, max_chars=20),
        Column("employee_name", TEXT, required=True, max_chars=100),
        Column("department", TEXT, required=True, allowed=DEPARTMENTS),
        Column("position", TEXT, max_chars=50),
        Column("contact_phone", TEXT, max_chars=50),
        Column("email", TEXT, max_chars=100),
        Column("employment_status", TEXT, default="active", allowed=EMPLOYMENT_STATUSES),
        Column("warehouse_id", INT),
        Column("created_time", STAMP, default=AS_OF),
    ),
    references=(Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "null"),),
    unique=("employee_number",),
)

INVENTORY = Table(
    "inventory",
    ("inventory_id",),
    (
        Column("inventory_id", LONG, required=True),
        Column("product_id", INT, required=True),
        Column("warehouse_id", INT, required=True),
        Column("storage_location", TEXT, max_chars=100),
        Column("total_quantity", INT, default=0),
        Column("locked_quantity", INT, default=0),
        Column("available_quantity", INT, default=0),
        Column("unit", TEXT, default="pcs", max_chars=20),
        Column("production_date", DATE),
        Column("expiry_date", DATE),
        Column("inventory_status", TEXT, default="normal", allowed=INVENTORY_STATUSES),
        Column("parent_inventory_id", LONG),
        Column("last_updated", STAMP, default=AS_OF),
    ),
    references=(
        Reference(("product_id",), "products", ("product_id",), "cascade"),
        Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "cascade"),
        Reference(
            ("warehouse_id", "storage_location"),
            "locations",
            ("warehouse_id", "location"),
            "cascade",
        ),
        Reference(("parent_inventory_id",), "inventory", ("inventory_id",), "null"),
    ),
    checks=(
        ("total_not_negative", "total_quantity >= 0"),
        ("locked_not_negative", "locked_quantity >= 0"),
        ("available_not_negative", "available_quantity >= 0"),
        ("total_is_locked_plus_available", "total_quantity = locked_quantity + available_quantity"),
    ),
)

INBOUND_ORDERS = Table(
    "inbound_orders",
    ("inbound_id",),
    (
        Column("inbound_id", LONG, required=True),
        Column("product_id", INT),
        Column("inbound_type", TEXT, required=True, allowed=INBOUND_TYPES),
        Column("warehouse_id", INT, required=True),
        Column("expected_quantity", INT),
        Column("actual_quantity", INT),
        Column("total_items", INT),
        Column("status", TEXT, default="pending", allowed=INBOUND_STATUSES),
        Column("created_time", STAMP, default=AS_OF),
        Column("received_time", STAMP),
        Column("operator", INT, required=True),
        Column("notes", TEXT),
    ),
    references=(
        Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "cascade"),
        Reference(("product_id",), "products", ("product_id",), "cascade"),
        Reference(("operator",), "employees", ("employee_id",), "restrict"),
    ),
    checks=(
        ("expected_not_negative", "expected_quantity >= 0"),
        ("actual_not_negative", "actual_quantity >= 0"),
    ),
)

OUTBOUND_ORDERS = Table(
    "outbound_orders",
    ("outbound_id",),
    (
        Column("outbound_id", LONG, required=True),
        Column("product_id", INT),
        Column("outbound_type", TEXT, required=True, allowed=OUTBOUND_TYPES),
        Column("warehouse_id", INT, required=True),
        Column("total_items", INT),
        Column("total_quantity", INT),
        Column("status", TEXT, default="pending", allowed=OUTBOUND_STATUSES),
        Column("picker", INT),
        Column("packer", INT),
        Column("created_time", STAMP, default=AS_OF),
        Column("shipped_time", STAMP),
    ),
    references=(
        Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "cascade"),
        Reference(("product_id",), "products", ("product_id",), "cascade"),
        Reference(("picker",), "employees", ("employee_id",), "null"),
        Reference(("packer",), "employees", ("employee_id",), "null"),
    ),
)

INVENTORY_ADJUSTMENTS = Table(
    "inventory_adjustments",
    ("adjustment_id",),
    (
        Column("adjustment_id", LONG, required=True),
        Column("adjustment_type", TEXT, required=True, allowed=ADJUSTMENT_TYPES),
        Column("warehouse_id", INT, required=True),
        Column("product_id", INT, required=True),
        Column("inventory_id", LONG, required=True),
        Column("before_quantity", INT),
        Column("after_quantity", INT),
        Column("quantity_change", INT),
        Column("adjustment_reason", TEXT, max_chars=200),
        Column("operator", INT),
        Column("adjustment_time", STAMP, default=AS_OF),
        Column("notes", TEXT),
    ),
    references=(
        Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "cascade"),
        Reference(("product_id",), "products", ("product_id",), "cascade"),
        Reference(("inventory_id",), "inventory", ("inventory_id",), "cascade"),
        Reference(("operator",), "employees", ("employee_id",), "restrict"),
    ),
    checks=(
        ("before_not_negative", "before_quantity >= 0"),
        ("after_not_negative", "after_quantity >= 0"),
    ),
)

#: The ten base tables in load order (parents first).
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        WAREHOUSES,
        LOCATIONS,
        SUPPLIERS,
        PRODUCTS,
        SUPPLIER_PRODUCTS,
        EMPLOYEES,
        INVENTORY,
        INBOUND_ORDERS,
        OUTBOUND_ORDERS,
        INVENTORY_ADJUSTMENTS,
    )
}



def parents_first(names: Iterable[str]) -> list[str]:
    """Names of tables in an order in which every table comes after those it refers to."""
    wanted = set(names)
    graph = {n: {r.parent for r in TABLES[n].references if r.parent != n} for n in TABLES}
    return [n for n in TopologicalSorter(graph).static_order() if n in wanted]


SUPPLIER_MONTHLY_REPORT = Table(
    "supplier_monthly_report",
    ("report_month", "supplier_id"),
    (
        Column("report_month", TEXT, max_chars=7),
        Column("supplier_id", INT),
        Column("supplier_name", TEXT, max_chars=200),
        Column("total_inbound", dec(22, 4)),
        Column("return_count", LONG),
        Column("quality_score", dec(5, 2)),
        Column("created_at", STAMP),
    ),
)


def _alert_table(direction: str) -> Table:
    order_id = f"{direction}_id"
    return Table(
        f"{direction}_delay_alerts",
        (order_id,),
        (
            Column(order_id, LONG, required=True),
            Column("reference_number", TEXT, max_chars=100),
            Column("warehouse_id", INT),
            Column("product_id", INT),
            Column("delay_days", INT),
            Column("alert_level", TEXT, default="warning", allowed=("warning", "critical")),
            Column("alert_message", TEXT, max_chars=500),
            Column("created_at", STAMP, default=AS_OF),
        ),
        references=(
            Reference((order_id,), f"{direction}_orders", (order_id,), "cascade"),
            Reference(("warehouse_id",), "warehouses", ("warehouse_id",), "null"),
            Reference(("product_id",), "products", ("product_id",), "null"),
        ),
    )


ALERT_TABLES: dict[str, Table] = {
    t.name: t for t in (_alert_table("inbound"), _alert_table("outbound"))
}
